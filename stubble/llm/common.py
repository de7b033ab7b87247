"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stubble.operators.staging import staged

#: ASCII white space, the separators of words in the word contracts.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch inside ``small_batches``.
BATCH_ROWS = 2500
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, _UPPER, _UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_fields(df: DataFrame, without: str | None, ddl: str) -> tuple[list[int], StructType]:
    """Places of the columns that stay, and the schema with the columns of ``ddl`` behind.

    ``without`` goes, and so does what bears the name of a new column: that one replaces it.
    """
    added = StructType.fromDDL(ddl)
    taken = {n.lower() for n in added.names}
    fields = df.schema.fields
    kept = [i for i, f in enumerate(fields) if f.name != without and f.name.lower() not in taken]
    return kept, StructType([*(fields[i] for i in kept), *added.fields])


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of what is planned inside have at most ``rows`` rows; then the session's own bound holds again.

    A batch is held by the executor, in buffers that double as they grow, and by its Python worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    if not 0 < int(own) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def rows_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A parameter list (rules, quotas) as a table."""
    return spark.createDataFrame(rows, schema)


def numbered(df: DataFrame, keys: list[str], order: list[str], rows: int, name: str) -> DataFrame:
    """Gapless numbers from 0 per key, without gathering the rows of a key in one task.

    Rows of a key are dealt into about sqrt(rows) buckets by the hash of ``order``. The
    bucket sizes are partial counts; their running sums give each bucket its first
    number. A task then sorts single buckets only. Rows equal in ``order`` are numbered
    in any order.
    """
    buckets = max(1, math.isqrt(max(rows, 1)))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = staged(
        sizes.select(
            *keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")
        )
    )
    within = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    return (
        dealt.join(first, [*keys, "__bucket"])
        .withColumn(name, F.col("__first") + F.row_number().over(within) - 1)
        .drop("__bucket", "__first")
    )
