"""GeoJSON documents read by many tasks against the whole-document reader."""

import json

import pytest
from pyspark.sql import functions as F

from stubble.sinks.geojson import write_point_features, write_ring_features
from stubble.sources import geojson, geojson_split

NAMES = ["plain", "a}b", '{"q": 1}', "back\\slash\\", 'quote " in', '\\"}{', "}{}{", "[x]", "new\nline", "é😀}", '\\\\"', "", None]
WANTED = {"ID2": "int", "Row2": "string", "Strip": "int", "Size": "double"}


def document(n):
    features = [
        {
            "type": "Feature",
            "properties": {"ID2": str(i), "Row2": NAMES[i % len(NAMES)], "Size": "x" if i % 5 == 0 else i / 4, "more": {"deep": [{"x": "}"}]}},
            "geometry": {"type": "Point", "coordinates": [i * 0.5, -i]} if i % 7 else None,
        }
        for i in range(n)
    ]
    crs = {"type": "name", "properties": {"name": "urn"}}
    return {"type": "FeatureCollection", "name": 'odd } name " {', "crs": crs, "features": features, "after": {"a": "}"}}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("indent", [None, 2])
def test_one_document_is_read_by_many_tasks(spark, tmp_path, small_splits, indent):
    path = f"{tmp_path}/points.geojson"
    for n in (0, 1, 150):
        with open(path, "w", encoding="utf-8") as f:
            json.dump(document(n), f, indent=indent, ensure_ascii=indent is None)
        got = rows(geojson_split.read_points(spark, path, WANTED))
        assert len(got) == n
        assert got == rows(geojson.read_points(spark, path, WANTED))
    parts = spark.read.option("lineSep", "}").text(path).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 20


def test_several_documents_and_rings(spark, tmp_path, small_splits):
    shapes = [[[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]], [[[5.5, 0], [6, 0], [6, 1.25], [5.5, 0]]]]
    for name in ("a", "b"):
        features = [{"type": "Feature", "properties": {"Id": i}, "geometry": {"type": "Polygon", "coordinates": s}} for i, s in enumerate(shapes)]
        with open(f"{tmp_path}/{name}.json", "w") as f:
            json.dump({"type": "FeatureCollection", "features": features}, f)
    assert rows(geojson_split.read_rings(spark, str(tmp_path))) == rows(geojson.read_rings(spark, str(tmp_path)))


def test_documents_written_in_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        points = spark.createDataFrame([(i, NAMES[i % len(NAMES)], i / 3, -i / 7) for i in range(60)], "ID2 int, Row2 string, X double, Y double")
        write_point_features(points, f"{tmp_path}/points", "X", "Y", ["ID2", "Row2"], ["ID2"])
        rings = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (0.5, 2.0)])], "Id int, ring array<struct<x:double,y:double>>")
        write_ring_features(rings, f"{tmp_path}/rings", "ring", ["Id"], ["Id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    files = sorted((tmp_path / "points").glob("part-*"))
    assert len(files) > 2
    whole = json.loads("".join(f.read_text() for f in files))
    assert [f["properties"]["ID2"] for f in whole["features"]] == list(range(60))
    back = geojson_split.read_points(spark, f"{tmp_path}/points", {"ID2": "int", "Row2": "string"}, folder=True)
    assert rows(back.select("ID2", "Row2", "X", "Y")) == rows(points)
    ring = geojson_split.read_rings(spark, f"{tmp_path}/rings", folder=True).first()
    assert [tuple(p) for p in ring["ring"]] == [(0.0, 0.0), (1.0, 0.0), (0.5, 2.0), (0.0, 0.0)]
    # An empty table is a document without features.
    write_point_features(points.limit(0), f"{tmp_path}/none", "X", "Y", ["ID2"], ["ID2"])
    assert rows(geojson_split.read_points(spark, f"{tmp_path}/none", {"ID2": "int"}, folder=True)) == []
