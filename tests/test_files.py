"""Readers, writers, the curation run and the streaming form, on temporary files."""

import json

import pytest
from pyspark.sql import functions as F

from stubble.functions.measures import harvest_index
from stubble.functions.naming import AUDIT
from stubble.operators.qc import init_audit
from stubble.plans.curation import Rules, curate, no_edits, run
from stubble.plans.review import method_comparison, with_later_survey, yearly_means
from stubble.sinks.publish import (
    data_dictionary,
    described,
    split_outputs,
    survey_file_name,
    write_csv,
    write_review,
    write_survey,
)
from stubble.sources.geojson import read_points, read_rings, ring_points
from stubble.sources.sheets import Sheet, numbered_lines, read_sheet, read_sheets
from stubble.sources.tables import (
    SAMPLE_COLUMNS,
    one_rule_per_column,
    read_bounds,
    read_edits,
    read_hi_bounds,
    read_inferred,
    read_observation_rules,
    read_samples,
)
from stubble.streaming import audit_stream, to_parquet


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def sample_line(**cells):
    return ",".join(str(cells.get(c, "")) for c in SAMPLE_COLUMNS)


HEADER = ",".join(SAMPLE_COLUMNS)


def test_samples_have_a_fixed_schema(spark, tmp_path):
    path = put(tmp_path, "s.csv", "\n".join([HEADER, sample_line(HarvestYear=1999, ID2=3, GrainCarbon="NaN", Crop="WW", Comments='"a, ""b"""')]) + "\n")
    row = read_samples(spark, path).first()
    assert (row["HarvestYear"], row["ID2"], row["Crop"], row["GrainCarbon"], row["Comments"]) == (1999, 3, "WW", None, 'a, "b"')
    assert read_samples(spark, path).schema["GrainMassWet"].dataType.typeName() == "double"
    assert read_inferred(spark, path).schema["ID2"].dataType.typeName() == "integer"


def test_rules(spark, tmp_path):
    edits = put(tmp_path, "e.csv", "ID,Verb,Variable,NewVal,Comment,Reviewer\n")
    assert read_edits(spark, edits).count() == 0
    edits = put(tmp_path, "f.csv", "ID,Verb,Variable,NewVal,Comment,Reviewer\nb,Update,M,1,x,r\na,Flag,M,,y,r\n")
    assert [r["ID"] for r in read_edits(spark, edits).orderBy("seq").collect()] == ["b", "a"]
    bounds = put(tmp_path, "b.csv", "Crop,FieldName,Lower,Upper,Reference\nWW,A_P1,0,1,\nWW,B_P1,,1,\nWW,C_P1,0,,\n")
    assert [r["FieldName"] for r in read_bounds(spark, bounds).collect()] == ["A_P1"]
    observed = put(tmp_path, "o.csv", 'Crop,FieldName,AffectedColumns,Lower,Upper,Reference\nWW,HI,"A_P2,B_P2",0.1,0.5,\nSB,HI,"A_P2,B_P2",,,\n')
    rules = read_observation_rules(spark, observed)
    assert [r["AffectedColumn"] for r in one_rule_per_column(rules).collect()] == ["A_P2", "B_P2"]
    hi = put(tmp_path, "h.csv", "﻿Crop,HIMin,HIMax\nGB,0.047,0.571\n")
    assert [tuple(r) for r in read_hi_bounds(spark, hi).collect()] == [("GB", 0.047, 0.571)]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 7) for i in range(1, 3001)]
    a = put(tmp_path, "a.txt", "\n".join(lines) + "\n")
    b = put(tmp_path, "b.txt", "only\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = numbered_lines(spark, [a, b])
        assert got.rdd.getNumPartitions() > 3
        rows = {(r["name"], r["line"]): r["value"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == {**{("a.txt", i + 1): v for i, v in enumerate(lines)}, ("b.txt", 1): "only"}


def test_lines_do_not_depend_on_the_split_at_reading(spark, tmp_path):
    lines = [f"line {i}" for i in range(1, 20001)]
    path = put(tmp_path, "a.txt", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = numbered_lines(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        rows = {r["line"]: r["value"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == {i + 1: v for i, v in enumerate(lines)}


def test_files_of_one_sheet_must_have_one_header(spark, tmp_path):
    a, b = put(tmp_path, "a.csv", "x,y\n1,2\n"), put(tmp_path, "b.csv", "y,x\n3,4\n")
    with pytest.raises(ValueError, match="different headers"):
        read_sheet(spark, [a, b], Sheet())


def test_lost_rows_are_reported(spark, tmp_path):
    lines = [sample_line(HarvestYear=y, ID2=1, Crop="WW") for y in (1980, 2005)]
    path = put(tmp_path, "s.csv", "\n".join([HEADER, *lines]) + "\n")
    none = no_edits(spark)
    bounds = spark.createDataFrame([], "Crop string, FieldName string, Lower double, Upper double")
    observed = spark.createDataFrame([], "Crop string, FieldName string, AffectedColumns string, Lower double, Upper double")
    rules = Rules(none, none, none, bounds, bounds, observed, observed)
    with pytest.warns(UserWarning, match="1 lie outside the year windows"):
        curate(read_samples(spark, path), rules)


def test_sheet_ranges_types_and_labels(spark, tmp_path):
    text = "Title,,\nSample,Mass,Odd\nk1,1.5,u\nk2,na,v\nk3,bad,w\n,,\nBlock 2,,\nk4,7,x\n"
    a, b = put(tmp_path, "sheet_1999.csv", text), put(tmp_path, "sheet_2000.csv", text)
    spec = Sheet(header=2, last=5, types=["string", "double", "skip"], label=("Year", r"(\d{4})"))
    got = sorted(tuple(r) for r in read_sheet(spark, [a, b], spec).select("Year", "Sample", F.coalesce("Mass", F.lit(-1.0))).collect())
    assert got == [(y, k, m) for y in (1999, 2000) for k, m in (("k1", 1.5), ("k2", -1.0), ("k3", -1.0))]
    second = Sheet(header=None, first=8, last=8, names=["Sample", "Other"], types=["string", "int", "skip"])
    both = read_sheets(spark, [(a, spec), (a, second)])
    assert both.columns == ["Year", "Sample", "Mass", "Other"] and both.count() == 4
    repeated = put(tmp_path, "r.csv", "a,a,\n1,2,3\n")
    assert read_sheet(spark, repeated, Sheet()).columns == ["a...1", "a...2", "...3"]


def test_geojson(spark, tmp_path):
    def feature(kind, coordinates, **properties):
        return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}

    points = {"type": "FeatureCollection", "features": [feature("Point", [-117.1, 46.7], ID2=5, Row2="A", Column="7", Strip=1, Field="B")]}
    path = put(tmp_path, "p.json", json.dumps(points, indent=1))
    got = read_points(spark, path, {"ID2": "bigint", "Row2": "string", "Column": "int", "Strip": "string"})
    assert got.columns == ["X", "Y", "ID2", "Row2", "Column"]
    assert tuple(got.first()) == (-117.1, 46.7, 5, "A", 7)
    ring = [[0, 0], [2, 0], [2, 2.5], [0, 0]]
    path = put(tmp_path, "b.json", json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [ring], Id=0)]}))
    assert ring_points(read_rings(spark, path)) == [tuple(map(float, p)) for p in ring]
    assert ring_points(read_rings(spark, path), feature=1) == []


def test_names_dictionary_and_review(spark, tmp_path):
    assert survey_file_name("1999-2016", "20240101", 1, 0) == "HY1999-2016_20240101_P1A0.csv"
    assert survey_file_name("2007", "20240101", None, 1, "x") == "HY2007_20240101_x.csv"
    df = spark.createDataFrame([(2, None, 1.5), (1, "b", None)], "ID2 int, Crop string, M double")
    shown = described(df, {"M": ("g/m2", "Mass")})
    dictionary = data_dictionary(shown)
    assert [tuple(r) for r in dictionary.collect()][2] == ("M", "g/m2", "Mass", "Double")
    path = write_survey(df, str(tmp_path), "1999", "20240101", 2, 1, None, dictionary, [F.asc_nulls_last("ID2")])
    lines = [l for f in sorted((tmp_path / "HY1999_20240101_P2A1.csv").glob("part*")) for l in f.read_text().splitlines()]
    assert lines[0] == "ID2,Crop,M" and "1,b," in lines and "2,,1.5" in lines
    assert path.endswith("HY1999_20240101_P2A1.csv")
    assert (tmp_path / "HY1999_20240101_P2A1_Dictionary.csv").is_dir()
    write_review(df, ["M", "ID2"], str(tmp_path / "review.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "review.csv")).columns == ["M", "ID2"]


def curation_inputs(spark, tmp_path):
    def line(year, id2, crop, **cells):
        return sample_line(HarvestYear=year, ID2=id2, Crop=crop, CropExists=1, **cells)

    both = {"GrainSampleArea": 2, "BiomassSampleArea": 2, "GrainMassWet": 100, "GrainMassAirDry": 90, "BiomassWet": 200, "GrainMassWetInBiomassSample": 40, "ResidueMassWetSubsample": 50, "ResidueMassAirDrySubsample": 40}
    wet = {"GrainSampleArea": 0, "BiomassSampleArea": 2, "GrainMassWet": 100, "BiomassWet": 300}
    text = [
        HEADER,
        line(1999, 1, "WW", GrainProtein=99, **both),
        line(1999, 2, "WW", GrainProtein=10, **both),
        line(2011, 1, "WW", SampleID="own", GrainProtein=11, **wet),
        line(2011, 2, "", SampleID="none", **wet),
        line(2030, 2, "WW", SampleID="late"),
    ]
    samples = read_samples(spark, put(tmp_path, "s.csv", "\n".join(text) + "\n"))
    edits = put(tmp_path, "e.csv", "ID,Verb,Variable,NewVal,Comment,Reviewer\n1999_2,Update,GrainProtein,12,typo,r\nown,Flag,GrainProtein,,odd,r\n")
    bounds2 = put(tmp_path, "b2.csv", "Crop,FieldName,Lower,Upper,Reference\nWW,GrainProtein_P1,7,22,\nGeneric,GrainProtein_P1,0,100,\nWW,GrainYieldWet_P2,,,\n")
    bounds3 = put(tmp_path, "b3.csv", "Crop,FieldName,Lower,Upper,Reference\nWW,GrainYieldAirDry_P3,0,3,x\n")
    head = "Crop,FieldName,AffectedColumns,Lower,Upper,Reference\n"
    hi2 = put(tmp_path, "h2.csv", head + 'WW,HarvestIndex,"GrainYieldAirDry_P2,ResidueMassAirDryPerArea_P2",0.08,0.641,\n')
    hi3 = put(tmp_path, "h3.csv", head + 'WW,HarvestIndex,"GrainYieldAirDry_P3,ResidueMassAirDryPerArea_P3",0.08,0.2,\n')
    return samples, Rules(
        read_edits(spark, edits),
        no_edits(spark),
        no_edits(spark),
        read_bounds(spark, bounds2),
        read_bounds(spark, bounds3),
        read_observation_rules(spark, hi2),
        read_observation_rules(spark, hi3),
    )


def test_curation_levels(spark, tmp_path):
    levels = curate(*curation_inputs(spark, tmp_path))
    raw = {r["SampleID"]: r for r in levels["P1A1"].collect()}
    assert set(raw) == {"1999_1", "1999_2", "own", "none", "late"}
    assert raw["1999_2"]["GrainProtein_P1"] == 12.0 and raw["own"]["GrainProtein_P1_qcResult"] == "000001"
    two = {r["SampleID"]: r.asDict() for r in levels["P2A3"].collect()}
    assert set(two) == {"1999_1", "1999_2", "own", "none"}, "years outside the windows take no part"
    assert two["1999_1"]["GrainProtein_P1_qcResult"] == "000010"
    assert two["1999_2"]["GrainProtein_P1_qcResult"] == "000000"
    assert two["own"]["GrainProtein_P1_qcApplied"] == "000011"
    assert two["1999_1"]["GrainYieldAirDry_P2_qcApplied"] == "000101"
    assert "GrainMassWet_P1" not in two["own"] and "GrainMassWet_P1_qcResult" not in two["own"]
    three = {r["SampleID"]: r.asDict() for r in levels["P3A3"].collect()}
    # Mean moisture 0.1 of grain and 0.2 of residue; wet yields 50 and 100 per area.
    assert three["own"]["GrainYieldAirDry_P3"] == pytest.approx(45.0)
    assert three["own"]["ResidueMassAirDryPerArea_P3"] == pytest.approx(80.0)
    assert three["own"]["GrainYieldAirDry_P3_qcResult"] == "000110"
    assert three["none"]["GrainYieldAirDry_P3"] is None, "a null crop has no mean"
    assert three["1999_1"]["GrainYieldAirDry_P3"] is None, "observed values are not modelled"


def test_publishing_three_files_per_level(spark, tmp_path):
    samples, rules = curation_inputs(spark, tmp_path)
    run(samples, rules, str(tmp_path / "out"), "HY", "20240101")
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == sorted(f"HY_{c}{k}_20240101.csv" for c in ("P1A1", "P2A3", "P3A3") for k in ("", "_Comprehensive", "_QC"))
    read = spark.read.option("header", True).option("inferSchema", True)
    clean = read.csv(str(tmp_path / "out" / "HY_P3A3_20240101.csv"))
    assert not [c for c in clean.columns if c.endswith((*AUDIT, "_P1", "_P2", "_P3"))]
    assert {"QCCoverage", "QCFlags", "GrainYieldAirDry"} <= set(clean.columns)
    row = clean.where("SampleID = 'own'").first()
    assert row["GrainYieldAirDry"] == pytest.approx(45.0)
    audit = read.csv(str(tmp_path / "out" / "HY_P3A3_QC_20240101.csv"))
    assert audit.columns[:2] == ["HarvestYear", "ID2"] and "QCFlags" not in audit.columns
    means = yearly_means(clean)
    assert "GrainYieldAirDry_mean" in means.columns and means.count() == 3
    later = spark.createDataFrame([("CE", 2017, 1, "WW", 4.0, 10.0)] * 2 + [("CW", 2017, 1, "WW", 1.0, 2.0)], "FieldId string, HarvestYear int, ID2 int, Crop string, GrainYieldDryPerArea double, BiomassDryPerArea double")
    merged = with_later_survey(clean, later, "CE")
    assert merged.count() == clean.count() + 1
    eras = {(r["Crop"], r["Era"]): r["GrainYieldAirDry_mean"] for r in method_comparison(merged, ["GrainYieldAirDry"]).collect()}
    assert eras["WW", "2017-2022"] == 4.0 and eras["WW", "1999-2010"] == pytest.approx(22.5)


def test_split_outputs(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "000000", 4.0)], "HarvestYear int, ID2 int, A_P1 double, A_P1_qcResult string, A double")
    audit, clean = split_outputs(df)
    assert audit.columns == ["HarvestYear", "ID2", "A_P1_qcResult"] and clean.columns == ["HarvestYear", "ID2", "A"]


def test_streaming_audit_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "WW", 10.0, 1.0), (2, "WW", 99.0, 1.0), (3, None, 5.0, None)], "ID2 int, Crop string, M_P1 double, N_P1 double")
    df.write.parquet(str(tmp_path / "in"))
    bounds = spark.createDataFrame([("WW", "M_P1", 0.0, 50.0)], "Crop string, FieldName string, Lower double, Upper double")
    observed = spark.createDataFrame([("WW", "HI", "M_P1,N_P1", 0.0, 0.95)], "Crop string, FieldName string, AffectedColumns string, Lower double, Upper double")
    derived = {"HI": harvest_index("M_P1", "N_P1")}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    audited = audit_stream(stream, bounds, observed, derived, ["ID2", "Crop"])
    job = to_parquet(audited, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("ID2").collect()
    want = audit_stream(df, bounds, observed, derived, ["ID2", "Crop"]).orderBy("ID2").collect()
    assert got == want and got[1]["M_P1_qcResult"] == "000110"
    assert len(init_audit(df, ["ID2", "Crop"]).columns) + 2 == len(got[0])


def test_write_csv_overwrites(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    for _ in range(2):
        write_csv(df, str(tmp_path / "x.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x.csv")).count() == 1
