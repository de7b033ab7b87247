"""A session with the settings the jobs are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution splits hot keys and sizes reducers. Methods over 8000 bytes are not
# compiled by the JVM, so larger stages fall back to one operator at a time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str, cpus: int, memory: str = "8g") -> SparkSession:
    """For tests and benchmarks; on a cluster pass ``SETTINGS`` to spark-submit."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
