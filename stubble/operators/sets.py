"""Unions, distinct rows and set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stubble.operators.joins import attach


def union_diagonal(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def append_strict(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows whose columns must all exist in the target."""
    unknown = [c for c in rows.columns if c not in df.columns]
    if unknown:
        raise ValueError(f"columns not in the target: {unknown}")
    return df.unionByName(rows, allowMissingColumns=True)


def difference(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Distinct key values of one frame that the other lacks."""
    return attach(df.select(key).distinct(), other.select(key).distinct(), [key], "left_anti")


def merge_surveys(
    df: DataFrame,
    later: DataFrame,
    site_column: str,
    site: str,
    derived: dict,
    renames: dict[str, str],
) -> DataFrame:
    """Append a later survey: one site, whole-row duplicates removed, columns mapped."""
    one_site = later.where(F.col(site_column) == site).distinct().withColumns(derived)
    return union_diagonal(df, one_site.select(*[F.col(a).alias(b) for a, b in renames.items()]))
