"""Joins, grid, sets, corrections, boundary and validation."""

import threading

import pytest
from pyspark.sql import functions as F

from stubble.operators import checks, grid
from stubble.operators.columns import (
    condense,
    drop_above_level,
    drop_with_audit,
    project,
    recode,
    rename_by_pattern,
    select_positions,
    strip_suffixes,
    try_cast_columns,
    with_audit_columns,
)
from stubble.operators.grid import append_missing, complete_grid
from stubble.operators.joins import (
    apply_corrections,
    attach,
    attach_points_full,
    attach_points_inner,
    correct,
    full_attach,
    in_ring,
    label_differences,
    merge_sides,
)
from stubble.operators.sets import append_strict, difference, merge_surveys, union_diagonal
from stubble.operators.staging import staged, staging_root


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))


def test_attach_matches_nulls_only_when_asked(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y")], "j int, r string")
    assert rows(attach(left, right, {"k": "j"})) == [(None, "b", "y"), (1, "a", "x")]
    assert rows(attach(left, right, {"k": "j"}, null_safe=False)) == [(None, "b", None), (1, "a", "x")]


def test_points_full(spark):
    samples = spark.createDataFrame([(1, "A", 10), (1, None, 11), (9, "Z", 12), (1, "A", 13)], "Column int, Row2 string, v int")
    points = spark.createDataFrame([(1, "A", 0.5), (1, None, 0.6), (2, "B", 0.7)], "Column int, Row2 string, X double")
    assert rows(attach_points_full(samples, points, ["Column", "Row2"])) == [
        (1, None, 11, 0.6),
        (1, "A", 10, 0.5),
        (1, "A", 13, 0.5),
        (2, "B", None, 0.7),
        (9, "Z", 12, None),
    ]


def test_points_inner(spark):
    samples = spark.createDataFrame([(1,), (3,)], "ID2 int")
    points = spark.createDataFrame([(1, 2.0, 3.0), (2, 0.0, 0.0)], "ID2 int, X double, Y double")
    got = attach_points_inner(samples, points, "ID2")
    assert got.columns == ["ID2", "Longitude", "Latitude"] and rows(got) == [(1, 2.0, 3.0)]


def test_full_attach_keeps_both_sides(spark):
    a = spark.createDataFrame([("k", 1), ("l", 2), (None, 3)], "b string, x int")
    b = spark.createDataFrame([("k", 4), ("m", 5), (None, 6)], "b string, y int")
    assert rows(full_attach(a, b, ["b"], unique=True)) == rows(full_attach(a, b, ["b"]))
    assert rows(full_attach(a, b, ["b"])) == [(None, 3, 6), ("k", 1, 4), ("l", 2, None), ("m", None, 5)]


def test_merge_sides_suffixes_shared_columns(spark):
    a = spark.createDataFrame([("k", 1, 2)], "Barcode string, v int, own int")
    b = spark.createDataFrame([("k", 3, 4)], "Sample string, v int, other int")
    got = merge_sides(a, b, "Barcode", "Sample")
    assert got.columns == ["Barcode", "v.x", "own", "v.y", "other"] and rows(got) == [("k", 1, 2, 3, 4)]


def test_grid_completion(spark):
    df = spark.createDataFrame(
        [(1999, 1), (1999, 2), (2000, 1), (2000, 3), (2001, 2), (None, 1), (2001, None)], "HarvestYear int, ID2 int"
    )
    gaps = rows(complete_grid(df, "HarvestYear", "ID2", 1999))
    assert gaps == [(2000, 2), (2001, 1)]
    points = spark.createDataFrame([(2, 0.5, 0.6, "A")], "ID2 int, X double, Y double, Row2 string")
    table = df.withColumns({"CropExists": F.lit(1), "Longitude": F.lit(None).cast("double"), "Latitude": F.lit(None).cast("double")})
    added = append_missing(table, points, 1999).where("CropExists = 0")
    assert rows(added) == [(2000, 2, 0, 0.5, 0.6)], "a gap without a reference point is not located"


def test_sets(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2.5, True)], "i double, t boolean")
    assert rows(union_diagonal(a, b)) == [(1.0, "x", None), (2.5, None, True)]
    with pytest.raises(ValueError, match="t"):
        append_strict(a, spark.createDataFrame([(1, True)], "i int, t boolean"))
    assert rows(append_strict(a, spark.createDataFrame([(5,)], "i int"))) == [(1, "x"), (5, None)]
    ids = spark.createDataFrame([(1,), (1,), (2,), (None,)], "i int")
    assert rows(difference(ids, a, "i")) == [(None,), (2,)]
    later = spark.createDataFrame([("CE", 9, 1.0), ("CE", 9, 1.0), ("XX", 8, 2.0)], "F string, i int, g double")
    got = merge_surveys(a, later, "F", "CE", {"h": F.col("g") * 2}, {"i": "i", "h": "H"})
    assert rows(got) == [(1, "x", None), (9, None, 2.0)]


def test_corrections(spark):
    df = spark.createDataFrame([(2001, 1, "WW", 5.0), (2001, 2, "WW", 6.0)], "y int, i int, c string, m double")
    fixes = spark.createDataFrame([(2001, 1, "m", None), (2001, 2, "m", 7.0)], "y int, i int, Variable string, NewVal double")
    assert rows(apply_corrections(df, fixes, ["y", "i"], ["m"])) == [(2001, 1, "WW", None), (2001, 2, "WW", 7.0)]
    cases = [({"y": 2001, "i": 1}, "SC"), ({"y": 2001}, None)]
    assert rows(correct(df, "c", cases).select("i", "c")) == [(1, "SC"), (2, None)]


def test_labels_and_recode(spark):
    own = spark.createDataFrame([(1, "WW"), (2, "SW"), (3, None)], "i int, c string")
    other = spark.createDataFrame([(1, "SW"), (2, "SW"), (3, "SW")], "i int, d string")
    assert rows(label_differences(own, other, ["i"], "c", "d")) == [(1, "WW", "SW")]
    assert rows(recode(own, {"WW": "X"})) == [(1, "X"), (2, "SW"), (3, None)]


RING = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]


def test_point_in_ring(spark):
    pts = [(1.0, 1.0, True), (2.0, 2.0, False), (3.0, 2.0, True), (5.0, 1.0, False), (2.0, -1.0, False), (None, 1.0, None)]
    df = spark.createDataFrame(pts, "x double, y double, e boolean")
    assert all(r[0] == r[1] for r in df.select(in_ring("x", "y", RING), "e").collect())
    assert [r[0] for r in df.select(in_ring("x", "y", RING[:-1])).collect()] == [p[2] for p in pts]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, "q", 3.0, None, 5.0)], "ID2 int, A_P1 double, A_P1_qcResult string, A_P2 double, B_P1 double, B_P3 double")
    assert drop_above_level(df, 1).columns == ["ID2", "A_P1", "A_P1_qcResult", "B_P1"]
    assert drop_with_audit(df, ["A_P1"]).columns == ["ID2", "A_P2", "B_P1", "B_P3"]
    once = condense(df, 3)
    assert (once.first()["A"], once.first()["B"]) == (3.0, 5.0)
    assert condense(df, 1).first()["B"] is None and rows(condense(once, 3)) == rows(once)
    assert with_audit_columns(["X", "A_P1"]) == ["X", "A_P1", "A_P1_qcApplied", "A_P1_qcResult", "A_P1_qcPhrase"]
    with pytest.raises(ValueError):
        project(df, ["missing"])
    assert project(df, ["missing", "ID2"], fill_missing=True).first()["missing"] is None
    assert strip_suffixes(["A_P1", "P_P12", "B"], ["_P1", "_P2"]) == ["A", "P_P12", "B"]
    odd = spark.createDataFrame([("1", "x")], ["SW (%C)", "n"])
    assert rename_by_pattern(odd, {"%C": "C"}).columns == ["C", "n"]
    with pytest.raises(ValueError):
        rename_by_pattern(odd, {"%Z": "C"})
    assert select_positions(odd, {2: "b", 1: "a"}).columns == ["b", "a"]
    assert rows(try_cast_columns(odd, {"n": "int", "SW (%C)": "int"})) == [(1, None)]


def test_checks(spark):
    a = spark.createDataFrame([(1, 2000, 5.0, 5.0, "7"), (2, 2000, 6.0, None, "x"), (3, 2001, 1.0, 2.0, "3")], "i int, y int, m double, n double, t string")
    b = spark.createDataFrame([(1, 5.0), (2, 7.0), (4, 1.0)], "i int, o double")
    got = rows(checks.total_differences(a, b, ["i"], "m", "o", ["y"]))
    assert got == [(None, None, 0, 0, 0, 1), (2000, -1.0, 1, 2, 0, 0), (2001, None, 0, 0, 1, 0)]
    with pytest.raises(ValueError, match="totals differ"):
        checks.require_totals_agree(a, b, ["i"], "m", "o", ["y"])
    assert rows(checks.column_mismatches(a, [("m", "n")])) == [(2,)]
    other = a.select("i", F.when(F.col("i") == 1, 9.0).otherwise(F.col("m")).alias("m"))
    assert rows(checks.measure_mismatches(a, other, ["i"], ["m"], 0.5)) == [(3, 1)]
    assert [r["i"] for r in checks.key_disagreements(a, "i", "t").collect()] == [1]
    assert [r["i"] for r in checks.recomputed_differs(a, "m", "n", 0.5).collect()] == [3]
    with pytest.raises(ValueError, match="row count"):
        checks.require_same_rows(a, b.limit(1))


@pytest.mark.parametrize("tolerance", [0.0, 0.5, 1.0])
def test_mismatches_of_repeated_and_null_keys_are_counted_by_pair(spark, tolerance):
    inf, nan = float("inf"), float("nan")
    values = [None, 0.0, -0.0, 0.5, 1.0, 1.25, -3.0, 1e300, inf, -inf, nan]
    mine = [(k, v, float(i % 3)) for k in ("x", None, "x", "y") for i, v in enumerate(values)]
    theirs = [(k, v, None if i % 5 == 0 else 1.0) for k in (None, "x", None, "z") for i, v in enumerate(values[::-1])]
    a, b = (spark.createDataFrame(r, "i string, m double, n double") for r in (mine, theirs))
    pairs = a.alias("a").join(b.alias("b"), F.expr("a.i <=> b.i"))
    off = [F.count_if(F.coalesce(F.expr(f"abs(a.{c} - b.{c}) > {tolerance}"), F.lit(False))) for c in "mn"]
    expected = rows(pairs.agg(F.count("*"), *off))
    assert rows(checks.measure_mismatches(a, b, ["i"], ["m", "n"], tolerance)) == expected
    assert rows(checks.measure_mismatches(a.limit(0), b, ["i"], ["m"], tolerance)) == [(0, 0)]


def test_mismatches_of_many_rows_without_a_key(spark):
    n = 100_000
    a = spark.range(n).select(F.lit(None).cast("string").alias("i"), (F.col("id") * 1.5).alias("m"))
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)  # pair by pair these are 10 to the power of 10
    stop.start()
    try:
        assert rows(checks.measure_mismatches(a, a, ["i"], ["m"], 0.0)) == [(n * n, n * n - n)]
    finally:
        stop.cancel()


def test_totals_see_errors_that_cancel_and_missing_rows(spark):
    a = spark.createDataFrame([(1, 2000, 5.0), (2, 2000, 6.0)], "i int, y int, m double")
    same = a.select("i", F.col("m").alias("o"))
    checks.require_totals_agree(a, same, ["i"], "m", "o", ["y"])
    off = same.withColumn("o", F.col("o") + F.when(F.col("i") == 1, 5).otherwise(-5))
    for other in (off, same.where("i = 1")):
        with pytest.raises(ValueError, match="totals differ"):
            checks.require_totals_agree(a, other, ["i"], "m", "o", ["y"])
    with pytest.raises(ValueError, match="totals differ"):
        checks.require_totals_agree(a.where("i = 2"), same, ["i"], "m", "o", ["y"])


def test_corrections_must_name_one_value_of_a_target(spark):
    df = spark.createDataFrame([(1, 5.0)], "i int, m double")
    schema = "i int, Variable string, NewVal double"
    with pytest.raises(ValueError, match="no targets"):
        apply_corrections(df, spark.createDataFrame([(1, "x", 1.0)], schema), ["i"], ["m"])
    twice = spark.createDataFrame([(1, "m", None), (1, "m", 1.0)], schema)
    with pytest.raises(ValueError, match="more than one"):
        apply_corrections(df, twice, ["i"], ["m"])


def test_staged_table_is_read_back(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    again = staged(df)
    assert rows(again) == rows(df) and again.schema == df.schema
    assert staging_root(spark)


def test_a_grid_of_too_many_years_raises(spark, monkeypatch):
    monkeypatch.setattr(grid, "MOST_YEARS", 3)
    df = spark.createDataFrame([(y, 1) for y in range(4)], "HarvestYear int, ID2 int")
    with pytest.raises(ValueError, match="HarvestYear"):
        complete_grid(df, "HarvestYear", "ID2", 0)
    assert complete_grid(df.where("HarvestYear < 3"), "HarvestYear", "ID2", 0).count() == 0
