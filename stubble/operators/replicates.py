"""Collapse and choose among repeated rows of one sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stubble.functions import as_col


def file_rank(order: list[str]) -> Column:
    """Row order as one comparable value; a single column stays plain, which hashes faster."""
    return as_col(order[0]) if len(order) == 1 else F.struct(*[as_col(o) for o in order])


def first_non_null(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per group: each column's first non-null value in row order."""
    rank = file_rank(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(
        *[
            F.min_by(as_col(c), F.when(as_col(c).isNotNull(), rank)).alias(c)
            for c in rest
        ]
    )


def choose_replicates(
    df: DataFrame, key: str, tiers: list[Column], mass: str, order: list[str]
) -> DataFrame:
    """One row per key by priority tiers.

    A key with one row keeps it. Otherwise the first tier wins that has one row, or
    several of which exactly half repeat another row, or several of one mass; its first
    row in file order is kept. A key that passes no tier is dropped.

    Equal rows are counted together first, so a hot key shrinks to its distinct rows
    and then to one small set of partial sums; no group is gathered or sorted.
    """
    data = [c for c in df.columns if c not in order]
    rank = file_rank(order)
    flags = {f"__t{i}": F.coalesce(t, F.lit(False)) for i, t in enumerate(tiers)}
    distinct_rows = df.groupBy(*[as_col(c) for c in data]).agg(
        F.count("*").alias("__copies"), F.min(rank).alias("__first")
    )
    flagged = distinct_rows.where(as_col(key).isNotNull()).withColumns(flags)
    row = F.struct(*[as_col(c) for c in data])
    sums = [F.sum("__copies").alias("__all"), F.min_by(row, F.col("__first")).alias("__any")]
    for i in range(len(tiers)):
        on = F.col(f"__t{i}")
        sums += [
            F.sum(F.when(on, F.col("__copies"))).alias(f"__rows{i}"),
            F.count(F.when(on, 1)).alias(f"__kinds{i}"),
            F.count(F.when(on, as_col(mass))).alias(f"__weighed{i}"),
            F.min(F.when(on, as_col(mass))).alias(f"__low{i}"),
            F.max(F.when(on, as_col(mass))).alias(f"__high{i}"),
            F.min_by(row, F.when(on, F.col("__first"))).alias(f"__pick{i}"),
        ]
    grouped = flagged.groupBy(as_col(key).alias("__key")).agg(*sums)
    choice = F.when(F.col("__all") == 1, F.col("__any"))
    for i in range(len(tiers)):
        rows, kinds, weighed = (F.col(f"__{n}{i}") for n in ("rows", "kinds", "weighed"))
        half_repeat = (rows - kinds) * 2 == rows
        one_mass = (weighed == 0) | (
            (weighed == kinds) & (F.col(f"__low{i}") == F.col(f"__high{i}"))
        )
        choice = choice.when(
            (rows == 1) | ((rows > 1) & (half_repeat | one_mass)), F.col(f"__pick{i}")
        )
    return (
        grouped.select(choice.alias("__row"))
        .where(F.col("__row").isNotNull())
        .select(*[F.col("__row")[c].alias(c) for c in data])
    )


def duplicate_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: rows, rows that repeat another, distinct values of one column.

    A null is one of the distinct values.
    """
    kinds = df.groupBy(*df.columns).agg(F.count("*").alias("__copies"))
    per_value = kinds.groupBy(*keys, as_col(value).alias("__value")).agg(
        F.sum("__copies").alias("__rows"), F.count("*").alias("__kinds")
    )
    return per_value.groupBy(*keys).agg(
        F.sum("__rows").alias("n_rows"),
        (F.sum("__rows") - F.sum("__kinds")).alias("n_repeats"),
        F.count("*").alias("n_values"),
    )
