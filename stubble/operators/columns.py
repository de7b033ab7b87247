"""Projection operators driven by the naming contract."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stubble.functions import as_col, quoted
from stubble.functions.naming import (
    DIMENSIONS,
    LEVELS,
    audit_names,
    base_of,
    is_audit,
    level_of,
    measure_of,
)


def add_level(df: DataFrame, level: int = 1, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """Suffix every non-dimension column with its processing level."""
    return df.withColumnsRenamed(
        {c: f"{c}_P{level}" for c in df.columns if c not in dimensions}
    )


def with_audit_columns(columns: list[str], level: int = 1) -> list[str]:
    """Column order with the audit triplet after each column of a level."""
    ordered = []
    for c in columns:
        ordered.append(c)
        if level_of(c) == level and not is_audit(c):
            ordered += audit_names(c)
    return ordered


def project(df: DataFrame, columns: list[str], fill_missing: bool = False) -> DataFrame:
    """Ordered projection; with ``fill_missing`` absent columns become null."""
    present = set(df.columns)
    missing = [c for c in columns if c not in present]
    if missing and not fill_missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(
        *[F.col(quoted(c)) if c in present else F.lit(None).alias(c) for c in columns]
    )


def drop_above_level(df: DataFrame, level: int) -> DataFrame:
    """Drop measures and audit columns above a processing level."""
    return df.drop(*[c for c in df.columns if (level_of(c) or 0) > level])


def drop_with_audit(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop columns together with their audit triplets."""
    gone = set(columns)
    return df.drop(*[c for c in df.columns if measure_of(c) in gone])


def condense(df: DataFrame, level: int) -> DataFrame:
    """One column per measure: the value of the highest level present."""
    allowed = LEVELS[:level]
    found: dict[str, list[str]] = {}
    for c in df.columns:
        if not is_audit(c) and c.endswith(tuple(allowed)):
            found.setdefault(base_of(c), []).append(c)
    return df.withColumns(
        {
            base: F.coalesce(*[as_col(c) for c in sorted(cols, key=level_of, reverse=True)])
            for base, cols in found.items()
        }
    )


def rename_by_pattern(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Rename the one column whose name contains a text: ``{text: new name}``."""
    renames = {}
    for text, new in patterns.items():
        hits = [c for c in df.columns if text in c]
        if len(hits) != 1:
            raise ValueError(f"{len(hits)} columns contain {text!r}")
        renames[hits[0]] = new
    return df.withColumnsRenamed(renames)


def strip_suffixes(names: list[str], suffixes: list[str]) -> list[str]:
    """Names without the first matching suffix."""
    out = []
    for n in names:
        hit = next((s for s in suffixes if n.endswith(s)), "")
        out.append(n[: len(n) - len(hit)])
    return out


def select_positions(df: DataFrame, positions: dict[int, str]) -> DataFrame:
    """Positional select and rename: ``{1-based position: new name}``."""
    return df.select(
        *[F.col(quoted(df.columns[i - 1])).alias(n) for i, n in positions.items()]
    )


def recode(df: DataFrame, codes: dict[str, str], subset: list[str] | None = None) -> DataFrame:
    """Replace whole cell texts in every string column (or in a subset)."""
    return df.replace(codes, subset=subset)


def try_cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns; a cell that cannot be cast becomes null."""
    return df.withColumns({c: as_col(c).try_cast(t) for c, t in types.items()})


def clean_numbers(df: DataFrame) -> DataFrame:
    """Not-a-number becomes null in every floating column."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.nanvl(as_col(c), F.lit(None)) for c in floats})
