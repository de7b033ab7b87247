"""Exact quantiles of groups of any size.

Spark's own ``percentile`` keeps every distinct value of a group in one aggregation
buffer, which a hot group outgrows. Here a group is never gathered:

1. every value falls into an ordered bucket, a fixed function of the value alone, and
   rows are counted per (group, bucket) with partial aggregation before the shuffle;
2. running totals over the buckets of a group tell which buckets hold the wanted ranks;
3. a wanted bucket that still holds many rows of different values is cut into finer
   cells the same way, until none does;
4. only rows of the wanted cells are counted per distinct value and ranked.

Buckets and cells are functions of the value, so a recomputed task gives the same answer.
The input is read at least twice: stage it first when it is costly to compute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stubble.functions import as_col
from stubble.operators.joins import attach
from stubble.operators.staging import staged

# Buckets per power of two: a bucket spans a relative width of 1/8192.
RESOLUTION = 8192
# Most rows of different values that one task sorts.
CELL_ROWS = 5_000_000


def order_bucket(value, resolution: int = RESOLUTION) -> Column:
    """An integer that never decreases as the value grows."""
    v = as_col(value)
    size = F.abs(v)
    power = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1074))
    part = F.floor((size / F.pow(F.lit(2.0), power) - 1.0) * resolution)
    part = F.greatest(F.least(part, F.lit(resolution - 1)), F.lit(0))
    code = (power + 1075) * resolution + part + 1
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, code).otherwise(-code)


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    probs: list[float],
    resolution: int = RESOLUTION,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles per group, one row per group.

    Columns are named ``{column}_q{100 p}``, plus ``{column}_n`` for the non-null count.
    Groups whose columns are all null do not appear.
    """
    ids = [f"__k{i}" for i in range(len(keys))]
    long = (
        df.select(
            *[as_col(k).alias(i) for k, i in zip(keys, ids)],
            *[as_col(c).cast("double").alias(f"__v{j}") for j, c in enumerate(columns)],
        )
        .unpivot(ids, [f"__v{j}" for j in range(len(columns))], "__m", "__v")
        .where(F.col("__v").isNotNull() & ~F.isnan("__v"))
        .withColumn("__v", F.col("__v") + F.lit(0.0))
        .withColumn("__b", order_bucket("__v", resolution))
    )
    group = [*ids, "__m"]
    spots = F.array_distinct(
        F.array(
            *[
                side(F.lit(p) * (F.col("__n") - 1))
                for p in probs
                for side in (F.floor, F.ceil)
            ]
        )
    )

    def ranks_between(first: Column, after_last: Column) -> Column:
        return F.filter(spots, lambda r: (r >= first) & (r < after_last))

    def wanted(counted: DataFrame, parent: list[str], order: str, base: Column) -> DataFrame:
        """Cells that hold a wanted rank; ``__from`` is the rank of a cell's first row."""
        before = Window.partitionBy(*parent).orderBy(order).rowsBetween(
            Window.unboundedPreceding, -1
        )
        first = base + F.coalesce(F.sum("__c").over(before), F.lit(0))
        return (
            counted.withColumn("__from", first)
            .where(F.size(ranks_between(F.col("__from"), F.col("__from") + F.col("__c"))) > 0)
            .select(*group, "__b", "__n", "__from", "__c", "__lo", "__hi")
        )

    tally = [F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]
    buckets = (
        long.groupBy(*group, "__b")
        .agg(*tally)
        .withColumn("__n", F.sum("__c").over(Window.partitionBy(*group)))
    )
    cells = staged(wanted(buckets, group, "__b", F.lit(0)))
    while _crowded(cells, cell_rows):
        at = F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * resolution)
        parent = [*group, "__b", "__n", "__from"]
        finer = (
            _rows_of(long, cells, group)
            .withColumn("__cut", F.when(F.col("__hi") > F.col("__lo"), at).otherwise(F.lit(0)))
            .groupBy(*parent, "__cut")
            .agg(*tally)
            .withColumnRenamed("__from", "__base")
        )
        parent[-1] = "__base"
        cells = staged(wanted(finer, parent, "__cut", F.col("__base")))
    in_cell = Window.partitionBy(*group, "__from").orderBy("__v")
    ranked = (
        _rows_of(long, cells, group)
        .groupBy(*group, "__from", "__v")
        .agg(F.count("*").alias("__c"), F.max("__n").alias("__n"))
        .withColumn("__upto", F.col("__from") + F.sum("__c").over(in_cell))
        .withColumn(
            "__rank", F.explode(ranks_between(F.col("__upto") - F.col("__c"), F.col("__upto")))
        )
        .select(*group, "__n", "__rank", "__v")
    )
    sums = []
    for j, c in enumerate(columns):
        mine = F.col("__m") == f"__v{j}"
        sums.append(F.max(F.when(mine, F.col("__n"))).alias(f"__n{j}"))
        for i, p in enumerate(probs):
            spot = F.lit(p) * (F.col("__n") - 1)
            for side, fn in (("lo", F.floor), ("hi", F.ceil)):
                sums.append(
                    F.max(F.when(mine & (F.col("__rank") == fn(spot)), F.col("__v"))).alias(
                        f"__{side}{j}_{i}"
                    )
                )
    per_key = ranked.groupBy(*ids).agg(*sums)
    out = [F.col(i).alias(k) for k, i in zip(keys, ids)]
    for j, c in enumerate(columns):
        out.append(F.col(f"__n{j}").alias(f"{c}_n"))
        for i, p in enumerate(probs):
            spot = F.lit(p) * (F.col(f"__n{j}") - 1)
            share = spot - F.floor(spot)
            lo, hi = F.col(f"__lo{j}_{i}"), F.col(f"__hi{j}_{i}")
            out.append(
                F.when(lo == hi, lo).otherwise(lo + (hi - lo) * share).alias(quantile_name(c, p))
            )
    return per_key.select(*out)


def _crowded(cells: DataFrame, most: int) -> bool:
    """Does a wanted cell hold many rows of different values?"""
    return not cells.where((F.col("__c") > most) & (F.col("__lo") < F.col("__hi"))).isEmpty()


def _rows_of(long: DataFrame, cells: DataFrame, group: list[str]) -> DataFrame:
    """The values that lie in the wanted cells, each with its cell."""
    inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
    return attach(long, cells.drop("__c"), [*group, "__b"], "inner").where(inside)


def quantile_name(column: str, p: float) -> str:
    return f"{column}_q{100 * p:g}"


def quartiles(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return exact_quantiles(df, keys, columns, [0.25, 0.5, 0.75])


def quantiles_with_iqr(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Quartiles and interquartile range of one column per group."""
    q = quartiles(df, keys, [column])
    return q.withColumn(
        f"{column}_iqr",
        F.col(quantile_name(column, 0.75)) - F.col(quantile_name(column, 0.25)),
    )
