"""Levels published in one scan, whole or not at all; rows counted while a level is written."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stubble.operators.staging import staged_with
from stubble.plans import curation
from stubble.plans.curation import curate, run, staged_whole
from stubble.sinks.publish import split_outputs
from stubble.sinks.versions import current, publications, publish_version, read_level
from tests.compare import plan_of
from tests.test_files import curation_inputs

SCHEMA = "HarvestYear int, ID2 long, M_P1 double, M_P1_qcPhrase string, Note string"
ROWS = [(1999, i, i / 3 if i % 4 else None, f'says "{i}", twice' if i % 3 else None, "a\nb" if i % 5 == 0 else None) for i in range(50)]


def same(df, other):
    assert df.dtypes == other.dtypes
    assert sorted(map(str, df.collect())) == sorted(map(str, other.collect()))


def test_three_files_of_one_scan(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    counted = df.where(F.expr("ID2 >= 0"))
    assert publish_version(counted, str(tmp_path), "HY", 1, 1, "20240101") == 50
    audit, clean = split_outputs(df)
    same(read_level(spark, str(tmp_path), "HY", 1, 1, "Comprehensive"), df)
    same(read_level(spark, str(tmp_path), "HY", 1, 1, "QC"), audit)
    same(read_level(spark, str(tmp_path), "HY", 1, 1), clean)


def test_a_failed_publication_leaves_the_former_one(spark, tmp_path):
    folder = str(tmp_path)
    first = spark.createDataFrame(ROWS, SCHEMA)
    publish_version(first, folder, "HY", 1, 1, "20240101")
    # One row in the middle cannot be made, so the write breaks off after other rows were written.
    broken = first.repartition(4).withColumn("M_P1", F.when(F.col("ID2") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("M_P1")))
    with pytest.raises(Exception, match="lost"):
        publish_version(broken, folder, "HY", 1, 1, "20240102")
    same(read_level(spark, folder, "HY", 1, 1, "Comprehensive"), first)
    assert current(spark, folder, "HY", "P1A1")["date"] == "20240101"
    second = first.withColumn("M_P1", F.lit(1.0))
    publish_version(second, folder, "HY", 1, 1, "20240102")
    same(read_level(spark, folder, "HY", 1, 1, "Comprehensive"), second)
    assert publications(spark, folder).count() == 2


def test_empty_and_missing_levels(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert publish_version(df, str(tmp_path), "HY", 2, 1, "20240101") == 0
    same(read_level(spark, str(tmp_path), "HY", 2, 1, "Comprehensive"), df)
    with pytest.raises(ValueError):
        read_level(spark, str(tmp_path), "HY", 3, 1)
    assert publications(spark, f"{tmp_path}/nowhere").collect() == []


def test_the_whole_plan_published_by_manifest(spark, tmp_path):
    samples, rules = curation_inputs(spark, tmp_path)
    run(samples, rules, str(tmp_path / "out"), "HY", "20240101", whole=True)
    clean = read_level(spark, str(tmp_path / "out"), "HY", 3, 3)
    assert clean.where("SampleID = 'own'").first()["GrainYieldAirDry"] == pytest.approx(45.0)
    assert publications(spark, str(tmp_path / "out")).count() == 3


def test_rows_are_counted_while_they_are_written(spark):
    df, seen = staged_with(spark.range(1000).repartition(7), {"rows": F.count(F.lit(1)), "top": F.max("id")})
    assert seen == {"rows": 1000, "top": 999} and df.count() == 1000
    assert "CollectMetrics" not in plan_of(df)
    for rows in (999, 1001):
        with pytest.raises(ValueError, match="row count changed"):
            staged_whole(spark.range(1000), rows, "level")


def test_curation_counts_by_no_job_of_its_own_and_raises_on_lost_and_doubled_rows(spark, tmp_path, monkeypatch):
    samples, rules = curation_inputs(spark, tmp_path)
    calculated = curation.calculated
    for change in (lambda df: df.where("ID2 <> 1"), lambda df: df.unionByName(df.where("ID2 = 1"))):
        monkeypatch.setattr(curation, "calculated", lambda p1a1, regimes, f=change: f(calculated(p1a1, regimes)))
        # Edits must name one row each, which would be noticed before.
        monkeypatch.setattr(curation, "calculated_assured", lambda df, edits: df)
        with pytest.raises(ValueError, match="row count changed"):
            curate(samples, rules)
    monkeypatch.undo()
    jobs = []
    monkeypatch.setattr(type(samples), "count", lambda self: jobs.append(self), raising=False)
    curate(samples, rules)
    assert not jobs and isinstance(samples, DataFrame)
