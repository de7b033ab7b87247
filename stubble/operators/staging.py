"""Staged tables: cut lineage and give the optimizer true sizes.

A per-group summary or a rule table that is joined back to a large table is first
written to the shared checkpoint folder and read again. It is then computed once, it
outlives lost executors, and Spark knows its size on disk: the planner broadcasts it
when it is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a
shuffle join whose hot keys adaptive execution splits. No broadcast is forced.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="stubble-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_MADE: list[str] = []
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the folders that are staged inside, when a job has written its results."""
    begin = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[begin:]:
            _delete(spark, path)
        del _MADE[begin:]


def staged(df: DataFrame) -> DataFrame:
    """Write a frame once and return a frame that reads it."""
    path = f"{staging_root(df.sparkSession)}/stubble-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def unstaged(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads: all that needs them is itself staged."""
    for df in frames:
        path = _FOLDERS.pop(df)
        _delete(df.sparkSession, path)
        _MADE.remove(path)


def staged_with(df: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """Stage a frame, and aggregates of it that are taken while it is written.

    The aggregates stand on top of the plan, in the tasks that write, so each written row
    counts once and no further job reads the table.
    """
    seen = Observation()
    out = staged(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]))
    return out, seen.get
