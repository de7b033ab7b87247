"""Quantiles, outliers, replicates, group summaries and gap-fill on edge groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stubble.operators.gapfill import (
    fill_dry_from_moisture,
    fill_residue_by_regression,
    fill_residue_dry,
    fill_yield,
)
from stubble.operators.outliers import (
    add_outlier_class,
    add_quartile_class,
    map_layer,
    remove_extremes,
)
from stubble.operators.quantiles import exact_quantiles, order_bucket
from stubble.operators.replicates import choose_replicates, duplicate_counts, first_non_null
from stubble.operators.stats import (
    band_of,
    box_summary,
    histogram,
    linear_fit,
    side_by_side,
    with_tiered_mean,
)


def type7(values, p):
    """Linear-interpolated quantile by the textbook."""
    v = sorted(values)
    h = (len(v) - 1) * p
    lo, hi = math.floor(h), math.ceil(h)
    return v[lo] + (v[hi] - v[lo]) * (h - lo)


@pytest.mark.parametrize("resolution, cell_rows", [(8192, 5_000_000), (64, 5), (4, 50)])
def test_exact_quantiles_match_brute_force(spark, resolution, cell_rows):
    rng = random.Random(7)
    special = [0.0, -0.0, 5.0, -3.0, 8.0, 1e12, -1e-9, 1e-300, 7.999999999999999, None]
    groups = {
        # One group holds most rows, and one value holds most of that group.
        "hot": [5.0] * 900 + [rng.gauss(5, 1) for _ in range(600)],
        "mixed": [rng.choice([rng.gauss(0, 10), *special]) for _ in range(400)],
        None: [1.0, 2.0, 4.0],
        "single": [3.25],
        "empty": [None, None],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], ["v"], probs, resolution, cell_rows).collect()}
    assert set(got) == {"hot", "mixed", None, "single"}
    for k, r in got.items():
        present = [v for v in groups[k] if v is not None]
        assert r["v_n"] == len(present)
        for p in probs:
            assert r[f"v_q{100 * p:g}"] == pytest.approx(type7(present, p), rel=1e-12, abs=1e-300)


def test_order_bucket_never_decreases(spark):
    rng = random.Random(3)
    values = sorted(
        [math.ldexp(1.0, e) for e in range(-60, 60)]
        + [math.nextafter(math.ldexp(1.0, e), 0) for e in range(-60, 60)]
        + [rng.uniform(-1e6, 1e6) for _ in range(2000)]
        + [5e-324, 1.7e308, -1.7e308, 0.0]
    )
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    codes = [r[0] for r in df.orderBy("i").select(order_bucket("v")).collect()]
    assert codes == sorted(codes)


def test_outlier_and_quartile_classes(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 9.0, 100.0, None]
    df = spark.createDataFrame(
        [("a", i, v) for i, v in enumerate(values)] + [("t", 0, 2.0), ("t", 1, 2.0), ("n", 0, None)],
        "g string, i int, v double",
    )
    outliers = {(r["g"], r["i"]): r["Outliers"] for r in add_outlier_class(df, ["g"], "v").collect()}
    # Quartiles 2.5, 4, 7: inner fence 13.75, outer fence 20.5.
    assert [outliers["a", i] for i in range(8)] == [0, 0, 0, 0, 0, 0, 2, 0]
    quart = {(r["g"], r["i"]): r["Quartiles"] for r in add_quartile_class(df, ["g"], "v").collect()}
    assert [quart["a", i] for i in range(8)] == [1, 1, 2, 3, 3, 4, 4, None]
    assert quart["t", 0] == 4 and quart["n", 0] is None and outliers["n", 0] == 0
    kept = {(r["g"], r["i"]): r["v"] for r in remove_extremes(df, ["g"], ["v"]).collect()}
    assert kept["a", 6] is None and kept["a", 5] == 9.0 and kept["t", 1] == 2.0


def test_map_layer_is_empty_without_values(spark):
    df = spark.createDataFrame([("a", 1, None)], "g string, i int, v double")
    assert map_layer(df, "v", ["g"], ["i"]).count() == 0
    some = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0)], "g string, i int, v double")
    assert map_layer(some, "v", ["g"], ["i"], "i").count() == 2


def test_first_non_null(spark):
    rows = [("k", 1, None, "x"), ("k", 2, 2.0, None), ("k", 3, 3.0, "z"), (None, 4, None, "n"), (None, 5, 1.0, None)]
    df = spark.createDataFrame(rows, "k string, o int, a double, b string")
    got = {r["k"]: (r["a"], r["b"]) for r in first_non_null(df, ["k"], ["o"]).collect()}
    assert got == {"k": (2.0, "x"), None: (1.0, "n")}


REPS = "id int, o int, mass double, protein double, saved int, bag double"
LATE = 2015


@pytest.mark.parametrize(
    "name, rows, picked",
    [
        ("only row", [(1, 5.0, None, 2000, None)], 5.0),
        ("one with lab data", [(1, 5.0, None, 2016, 1.0), (2, 6.0, 9.0, 2000, None)], 6.0),
        ("half repeated", [(1, 6.0, 9.0, 2000, None), (2, 6.0, 9.0, 2000, None)], 6.0),
        ("one mass", [(2, 6.0, 9.0, 2000, None), (1, 6.0, 8.0, 2000, None), (3, 6.0, 7.0, 2000, None)], 6.0),
        ("falls to late", [(1, 5.0, 9.0, 2000, None), (2, 6.0, 8.0, 2016, None)], 6.0),
        ("falls to bag", [(1, 5.0, 9.0, 2000, 1.0), (2, 6.0, 8.0, 2000, None)], 5.0),
        ("no tier", [(1, 5.0, 9.0, 2000, None), (2, 6.0, 8.0, 2000, None)], None),
        ("null masses", [(1, None, 9.0, 2000, None), (2, None, 8.0, 2000, None)], "null"),
        ("null and a mass", [(1, None, 9.0, 2000, None), (2, 1.0, 8.0, 2000, None)], None),
        ("two distinct pairs", [(1, 5.0, 9.0, 2000, None), (2, 5.0, 9.0, 2000, None), (3, 6.0, 8.0, 2000, None), (4, 6.0, 8.0, 2000, None)], 5.0),
    ],
)
def test_choose_replicates(spark, name, rows, picked):
    df = spark.createDataFrame([(7, *r) for r in rows], REPS)
    tiers = [F.col("protein").isNotNull(), F.col("saved") >= LATE, F.col("bag").isNotNull()]
    got = choose_replicates(df, "id", tiers, "mass", ["o"]).collect()
    if picked is None:
        assert got == []
    else:
        assert len(got) == 1 and got[0]["mass"] == (None if picked == "null" else picked)


def test_duplicate_counts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in duplicate_counts(df, ["k"], "v").collect()}
    assert got == {"a": (3, 1, 2), "b": (1, 0, 1)}


def test_linear_fit_edge_groups(spark):
    rows = [("flat", 2.0, y) for y in (1.0, 3.0)] + [("one", 1.0, 5.0), ("none", None, 1.0)]
    rows += [("line", float(x), 2.0 * x + 1) for x in range(4)] + [("two", 0.0, 0.0), ("two", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in linear_fit(df, ["g"], "x", "y").collect()}
    assert set(got) == {"flat", "one", "line", "two"}
    assert (got["flat"]["XEstimate"], got["flat"]["InterceptEstimate"], got["flat"]["DfResidual"]) == (None, 2.0, 1)
    assert got["one"]["InterceptEstimate"] == 5.0 and got["one"]["DfResidual"] == 0
    assert (got["line"]["XEstimate"], got["line"]["AdjRSquared"]) == pytest.approx((2.0, 1.0))
    assert got["two"]["AdjRSquared"] is None and got["two"]["DfResidual"] == 0


def test_tiered_mean(spark):
    rows = [(1, "a", 2.0), (1, "a", 4.0), (2, "a", None), (2, None, 8.0), (3, None, None), (3, "b", None)]
    df = spark.createDataFrame(rows, "y int, c string, v double")
    got = {(r["y"], r["c"]): r["m"] for r in with_tiered_mean(df, ["y", "c"], ["c"], "v", "m").collect()}
    assert got == {(1, "a"): 3.0, (2, "a"): 3.0, (2, None): 8.0, (3, None): 8.0, (3, "b"): None}


def test_moisture_fill(spark):
    ok, bad = "000000", "000010"
    rows = [
        (1, "a", 10.0, 8.0, ok, ok),
        (2, "a", 10.0, 2.0, bad, ok),
        (3, "a", 20.0, None, ok, ok),
        (4, None, 20.0, None, ok, ok),
        (5, None, 20.0, 10.0, ok, ok),
        (6, "b", 20.0, None, ok, ok),
        (7, "b", 20.0, 10.0, ok, bad),
    ]
    schema = "i int, Crop string, W double, D double, W_qcResult string, D_qcResult string"
    df = spark.createDataFrame(rows, schema)
    got = {r["i"]: (r["D3"], r["mean"]) for r in fill_dry_from_moisture(df, [("W", "D", "D3", "mean")]).collect()}
    assert got[3] == pytest.approx((16.0, 0.2)) and got[1] == (None, pytest.approx(0.2))
    assert got[4] == (None, None) and got[5] == (None, None)
    assert got[6] == (None, None), "a group with only failed rows has no mean"


def test_residue_dry_fill(spark):
    rows = [("a", 10.0, 5.0, 2.0, None, 0.5), ("a", 8.0, None, 2.0, None, 0.25), ("a", 8.0, None, 0.0, 9.0, None)]
    schema = (
        "Crop string, ResidueMassWet double, ResidueMassDry double, ResidueSampleArea double, "
        "ResidueMassDryPerArea double, ResidueMoistureProportion double"
    )
    got = fill_residue_dry(spark.createDataFrame(rows, schema)).orderBy("ResidueMassWet", "ResidueSampleArea").collect()
    assert [r["ResidueMassDry_P2"] for r in got] == [5.0, 5.0, 5.0]
    assert [r["ResidueMassDryPerArea_P2"] for r in got] == [9.0, 2.5, 2.5]


def test_yield_fill_and_provenance(spark):
    rows = [(1, 1, "a", 10.0, 1), (1, 2, "a", None, 1), (1, 3, "a", None, 0), (2, 2, "a", None, 1), (2, 9, "a", None, 1)]
    df = spark.createDataFrame(rows, "HarvestYear int, ID2 int, Crop string, GrainYieldDryPerArea double, CropExists int")
    relative = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, 1.0)], "ID2 int, RelativeYield double")
    got = {
        (r["HarvestYear"], r["ID2"]): (r["GrainYieldDryPerArea_P3"], r["GrainYieldDryPerArea_P"])
        for r in fill_yield(df, relative).collect()
    }
    assert got == {(1, 1): (10.0, 2), (1, 2): (5.0, 3), (1, 3): (None, None), (2, 2): (5.0, 3), (2, 9): (None, None)}


def test_regression_fill(spark):
    fitted = [(1, "a", float(x), 2.0 * x) for x in (1, 2, 3)]
    rows = [
        *fitted,
        (1, "a", 5.0, None),
        (1, "b", 1.0, 100.0),
        (1, "b", 2.0, 100.0),
        (1, "b", 50.0, None),
        (2, "a", 4.0, None),
        (1, "AL", 4.0, 1.0),
        (1, "AL", 4.0, None),
        (1, "a", None, None),
    ]
    df = spark.createDataFrame(
        rows, "HarvestYear int, Crop string, GrainYieldDryPerArea_P3 double, ResidueMassDryPerArea_P2 double"
    )
    bounds = spark.createDataFrame([("a", 0.1, 0.9), ("b", 0.001, 0.1)], "Crop string, HIMin double, HIMax double")
    got = {
        (r["HarvestYear"], r["Crop"], r["GrainYieldDryPerArea_P3"]): (r["ResidueMassDryPerArea_P3"], r["ResidueMassDryPerArea_P"])
        for r in fill_residue_by_regression(df, bounds).collect()
    }
    assert got[1, "a", 2.0] == (4.0, 2), "observed values stay"
    assert got[1, "a", 5.0] == (pytest.approx(10.0), 3)
    mean_hi = (1 / 101 + 2 / 102) / 2
    assert got[1, "b", 50.0] == (pytest.approx(50 / mean_hi - 50), 3), "implausible line, index instead"
    assert got[2, "a", 4.0] == (pytest.approx(8.0), 3), "no fit that year, index of all years"
    assert got[1, "AL", 4.0] in [(1.0, 2), (pytest.approx(1.0), 3)]
    assert got[1, "a", None] == (None, None)


def test_bands_histogram_and_box(spark):
    years = spark.createDataFrame([(y,) for y in (1998, 1999, 2010, 2011)], "y int")
    assert [r[0] for r in years.select(band_of("y", [(1999, 2010), (2011, 2012)])).collect()] == [None, "1999-2010", "1999-2010", "2011-2012"]
    rows = [("a", float(v)) for v in range(11)] + [("c", 4.0), ("c", 4.0), ("n", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["bin"]): r["n"] for r in histogram(df, ["g"], "v", 5).collect()}
    assert got == {("a", 1): 2, ("a", 2): 2, ("a", 3): 2, ("a", 4): 2, ("a", 5): 3, ("c", 1): 2}
    box = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0, 50.0)], "g string, v double")
    assert tuple(box_summary(box, ["g"], "v").first()) == ("a", 5, 1.0, 2.0, 3.0, 4.0, 4.0)


def test_side_by_side_counts(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 2.0), ("a", None, 2.0)], "g string, x double, y double")
    r = side_by_side(df, ["g"], {"X": "x", "Y": "y"}, with_max=True).first()
    assert (r["meanX"], r["nX"], r["maxX"], r["nY"]) == (2.0, 2, 3.0, 2)
    assert r["seX"] == pytest.approx(math.sqrt(2) / math.sqrt(3))
