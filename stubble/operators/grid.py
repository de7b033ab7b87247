"""Completion of the (year, point) grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stubble.operators.joins import attach_points_inner
from stubble.operators.sets import append_strict
from stubble.operators.staging import staged

#: Years of a grid: every point gathers the ones it was seen in.
MOST_YEARS = 10_000


def complete_grid(
    df: DataFrame,
    year: str,
    point: str,
    base_year,
) -> DataFrame:
    """Missing (year, point) pairs for every point seen in the base year.

    Each point's seen years are gathered (at most one entry per year) and only the
    years it lacks are emitted; present pairs are never produced. Null years and null
    points take no part. The list of all years is one staged row that is joined to the
    points; more than ``MOST_YEARS`` of them raise.
    """
    seen_rows = df.select(year, point).where(F.col(year).isNotNull() & F.col(point).isNotNull())
    dtype = df.schema[year].dataType
    years = staged(seen_rows.groupBy(year).agg(F.lit(1).alias("__one")))
    if years.count() > MOST_YEARS:
        raise ValueError(f"more than {MOST_YEARS} values of {year}: no grid of years and points")
    all_years = staged(years.groupBy("__one").agg(F.collect_set(year).alias("__all")))
    seen = seen_rows.groupBy(point).agg(F.collect_set(year).alias("__seen"))
    # Every point was seen in some year, so all meet the one row.
    based = seen.where(F.array_contains("__seen", F.lit(base_year).cast(dtype))).withColumn(
        "__one", F.least(F.size("__seen"), F.lit(1))
    )
    return based.join(all_years, "__one").select(
        F.explode(F.array_except("__all", "__seen")).alias(year), point
    )


def append_missing(
    df: DataFrame,
    points: DataFrame,
    base_year,
    year: str = "HarvestYear",
    point: str = "ID2",
    present: str = "CropExists",
) -> DataFrame:
    """Append grid pairs without a sample, located and marked as not present."""
    gaps = complete_grid(df, year, point, base_year).withColumn(present, F.lit(0))
    located = attach_points_inner(gaps, points, point)
    extra = [c for c in located.columns if c not in df.columns]
    return append_strict(df, located.drop(*extra))
