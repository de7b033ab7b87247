"""The row-local checks over a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from stubble.queries.base import query, r, rounded, table
from stubble.queries.filing import fresh
from stubble.streaming import audit_stream, to_parquet

# Rules by event type: bounds of the value, and of its share of the number in the properties.
_BOUNDS = [("click", "M_P1", 10.0, 60.0), ("view", "M_P1", 0.0, 20.0), ("Generic", "M_P1", 0.0, 1.0)]
_OBSERVED = [("click", "Share", "M_P1", 0.1, 2.0), ("error", "Share", "M_P1", 0.0, 0.5)]

_FAILS = """coalesce(CASE event_type WHEN 'click' THEN value < 10 OR value > 60 WHEN 'view' THEN value < 0 OR value > 20 END, false)"""
_ODD = """coalesce(CASE event_type WHEN 'click' THEN share < 0.1 OR share > 2 WHEN 'error' THEN share < 0 OR share > 0.5 END, false)"""


@query(f"""WITH e AS (SELECT *, value / nullif(event_id % 97, 0) AS share FROM events),
c AS (SELECT *, {_FAILS} AS fails, {_ODD} AS odd FROM e)
SELECT event_id, {r("value")} AS M_P1,
  '000' || CASE WHEN event_type IN ('click', 'error') THEN '1' ELSE '0' END
    || CASE WHEN event_type IN ('click', 'view') THEN '1' ELSE '0' END || '1' AS M_P1_qcApplied,
  '000' || CASE WHEN odd THEN '1' ELSE '0' END || CASE WHEN fails THEN '1' ELSE '0' END || '0' AS M_P1_qcResult,
  CASE WHEN fails OR odd THEN 100.0::DOUBLE ELSE 0 END AS QCFlags FROM c""")
def streamed_audit(spark, sf_dir):
    """Events audited as they arrive; the stream is stopped, more files come, and it goes on."""
    source, out, state = (fresh(spark, n) for n in ("arriving", "audited", "stream"))
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("Crop"), F.col("value").alias("M_P1"), (F.col("event_id") % 97).alias("k")
    )
    bounds = spark.createDataFrame(_BOUNDS, "Crop string, FieldName string, Lower double, Upper double")
    observed = "Crop string, FieldName string, AffectedColumns string, Lower double, Upper double"
    rules = spark.createDataFrame(_OBSERVED, observed)
    share = F.col("M_P1") / F.nullif(F.col("k"), F.lit(0))
    for part in (0, 1):
        arrived = events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part)
        arrived.repartition(4).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
        audited = audit_stream(stream, bounds, rules, {"Share": share}, ["event_id", "Crop", "k"])
        to_parquet(audited, out, state).trigger(availableNow=True).start().awaitTermination()
    columns = ["event_id", "M_P1", "M_P1_qcApplied", "M_P1_qcResult", F.col("QCFlags").cast("double").alias("QCFlags")]
    return rounded(spark.read.parquet(out).select(*columns))
