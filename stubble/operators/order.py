"""Sorting, first rows, and exact row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stubble.functions import as_col
from stubble.operators.staging import staged


def sort_keys(keys: list[str], nulls: str = "first") -> list[Column]:
    """Ascending keys with nulls first or last."""
    if nulls == "first":
        return [as_col(k).asc_nulls_first() for k in keys]
    return [as_col(k).asc_nulls_last() for k in keys]


def sort_table(df: DataFrame, keys: list[str], nulls: str = "first") -> DataFrame:
    """Global sort; only worth its shuffle right before a table is written or shown."""
    return df.orderBy(*sort_keys(keys, nulls))


def first_rows(df: DataFrame, keys: list[str], n: int, nulls: str = "first") -> DataFrame:
    """The first n rows in key order, for a reader; each task keeps only its own n."""
    return sort_table(df, keys, nulls).limit(n)


def with_file_order(df: DataFrame, name: str = "__place") -> DataFrame:
    """A table just read from files, with the place of every row: file, block of it, row there.

    The place follows the names of the files and the order of their rows, however the files
    are split. It must be asked of the scan itself and staged before it is used twice.
    """
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return df.withColumn(name, F.struct(path.alias("path"), block.alias("block"), F.monotonically_increasing_id().alias("row")))


def row_numbers(df: DataFrame, keys: list[str], name: str, place: str | None = None, nulls: str = "last") -> DataFrame:
    """Exact numbers from 1 over the whole table in key order; ties follow ``place``.

    Rows are sorted into ranges; a range counts its rows, and the running sum of the ranges'
    counts gives each its first number. A task numbers one range, so no task sees the table,
    and a key that many rows share is split by ``place``. Without a ``place`` (as of
    ``with_file_order``) equal rows are numbered in any order.
    """
    order = [*sort_keys(keys, nulls), as_col(place) if place else F.monotonically_increasing_id()]
    tie = "__tie"
    placed = df.withColumn(tie, order[-1])
    sort = [*order[:-1], F.col(tie).asc()]
    ranges = staged(placed.repartitionByRange(*sort).withColumn("__range", F.spark_partition_id()))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    # One row per range: as many as tasks wrote ranges.
    first = staged(counts.select("__range", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__first")))
    within = Window.partitionBy("__range").orderBy(*sort)
    return (
        ranges.join(first, "__range")
        .withColumn(name, F.col("__first") + F.row_number().over(within))
        .drop("__range", "__first", tie)
    )
