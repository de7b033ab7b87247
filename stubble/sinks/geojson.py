"""Write a feature collection as one document, in parts that follow one another.

Spark names its part files in the order of their ranges, so the files of the folder, read
one after the other, are one GeoJSON document. ``sources.geojson_split`` reads such a folder
as one document; joined end to end the parts are a plain file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stubble.operators.order import row_numbers, sort_keys


def _write(df: DataFrame, folder: str, geometry: Column, properties: list[str], keys: list[str]) -> None:
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        geometry.alias("geometry"),
    )
    lines = row_numbers(df, keys, "__row").select("__row", F.to_json(feature).alias("value"))
    comma = F.when(F.col("__row") > 1, F.concat(F.lit(","), "value")).otherwise(F.col("value"))
    edges = [(0, '{"type":"FeatureCollection","features":['), ((1 << 63) - 1, "]}")]
    frame = df.sparkSession.createDataFrame(edges, "__row long, value string")
    whole = lines.withColumn("value", comma).unionByName(frame)
    whole.repartitionByRange("__row").sortWithinPartitions(*sort_keys(["__row"])).select("value").write.text(folder)


def write_point_features(df: DataFrame, folder: str, lon: str, lat: str, properties: list[str], keys: list[str]) -> None:
    """One point feature per row, in key order."""
    place = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    _write(df, folder, place, properties, keys)


def write_ring_features(df: DataFrame, folder: str, ring: str, properties: list[str], keys: list[str]) -> None:
    """One polygon feature per row from an array of corners (x, y), closed here, in key order."""
    closed = F.concat(F.col(ring), F.slice(ring, F.lit(1), F.lit(1)))
    corners = F.transform(closed, lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates"))
    _write(df, folder, shape, properties, keys)
