"""GeoJSON reference points and boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stubble.functions import as_col


def point_columns(properties: dict[str, str], dropped: tuple) -> tuple[str, list[Column]]:
    """The schema of a point feature, and its columns: X, Y and typed properties."""
    wanted = {n: t for n, t in properties.items() if n not in dropped}
    fields = ", ".join(f"{n}: string" for n in wanted)
    schema = f"properties: struct<{fields}>, geometry: struct<coordinates: array<double>>"
    feature = F.col("f")
    columns = [
        feature["geometry"]["coordinates"][0].alias("X"),
        feature["geometry"]["coordinates"][1].alias("Y"),
        *[feature["properties"][n].try_cast(t).alias(n) for n, t in wanted.items()],
    ]
    return schema, columns


def ring_columns() -> tuple[str, list[Column]]:
    """The schema of a polygon feature, and its columns: Id and the outer ring."""
    schema = "properties: struct<Id: int>, geometry: struct<coordinates: array<array<array<double>>>>"
    outer = F.col("f")["geometry"]["coordinates"][0]
    ring = F.transform(outer, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return schema, [F.col("f")["properties"]["Id"].alias("Id"), ring.alias("ring")]


def _features(spark: SparkSession, path, schema: str) -> DataFrame:
    whole = spark.read.schema(f"features array<struct<{schema}>>").json(path, multiLine=True)
    return whole.select(F.explode("features").alias("f"))


def read_points(
    spark: SparkSession,
    path,
    properties: dict[str, str],
    dropped: tuple = ("Strip", "Field"),
) -> DataFrame:
    """Point features as rows: X (longitude), Y (latitude) and typed properties.

    A document is read by one task; ``geojson_split`` reads large ones by many.
    """
    schema, columns = point_columns(properties, dropped)
    return _features(spark, path, schema).select(*columns)


def read_rings(spark: SparkSession, path) -> DataFrame:
    """Polygon features as rows: Id and the outer ring as an array of (x, y)."""
    schema, columns = ring_columns()
    return _features(spark, path, schema).select(*columns)


def ring_points(rings: DataFrame, feature: int = 0) -> list[tuple]:
    """The corner points of one boundary, for ``joins.in_ring``.

    A ring is one cell of one feature, and the test of a point needs all its corners.
    """
    rows = rings.where(as_col("Id") == feature).select("ring").collect()
    return [(p["x"], p["y"]) for r in rows for p in r["ring"]]
