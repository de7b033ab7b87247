"""The row-local checks over a stream.

Audit columns, bounds checks and the quality summary look at one row and at rule tables
that stay fixed, so they run unchanged on a streaming DataFrame. Group means, fences and
replicate choice need whole groups and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import DataStreamWriter

from stubble.operators.qc import add_qc_summary, bounds_check, init_audit, observation_check


def audit_stream(
    stream: DataFrame,
    bounds: DataFrame,
    observations: DataFrame,
    derived: dict[str, Column],
    dimensions: list[str],
) -> DataFrame:
    """Audit triplets, both checks and the summary for arriving rows."""
    audited = init_audit(stream, dimensions)
    checked = observation_check(bounds_check(audited, bounds), observations, derived)
    return add_qc_summary(checked, dimensions)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append the audited rows to a parquet folder, exactly once per row."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
