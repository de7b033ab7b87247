"""Q-Q points, densities and fences against plain computations, on odd groups too."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from stubble.functions.normal import normal_density, normal_quantile
from stubble.operators.distribution import density, plotting_positions, qq_points
from stubble.operators.fences import fence_check, fence_rules, outliers_removed
from stubble.operators.qc import init_audit

SCHEMA = "g string, v double"
VALUES = {
    "a": [float(i * i % 37) for i in range(50)],
    "tied": [5.0] * 30 + [6.0, 9.0],
    "same": [4.0] * 10,
    "zero": [0.0] * 3,
    "one": [7.0],
    "odd": [1.0, None, float("nan"), float("inf"), 3.0, -2.0],
    None: [1.0, 2.0, 4.0],
    "none": [None],
}


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(g, v) for g, vs in VALUES.items() for v in vs], SCHEMA)


def real(vs):
    return sorted(v for v in vs if v is not None and math.isfinite(v))


def quantile(vs, p):
    at = p * (len(vs) - 1)
    low = math.floor(at)
    return vs[low] + (vs[min(low + 1, len(vs) - 1)] - vs[low]) * (at - low)


def test_normal_functions(spark):
    probs = [1e-300, 1e-20, 1e-6, 0.01, 0.074, 0.0751, 0.3, 0.5, 0.77, 0.9249, 0.93, 0.999999, 1 - 1e-15]
    df = spark.createDataFrame([(p,) for p in [*probs, 0.0, 1.0, -1.0, 2.0, None]], "p double")
    got = [r[0] for r in df.select(normal_quantile("p")).collect()]
    assert got[len(probs) :] == [None] * 5
    for p, z in zip(probs, got):
        assert z == pytest.approx(statistics.NormalDist().inv_cdf(p), rel=1e-12, abs=1e-13)
    assert df.select(normal_density(F.lit(1.3))).first()[0] == pytest.approx(statistics.NormalDist().pdf(1.3))


def test_qq_points(table):
    got = {}
    for r in qq_points(table, ["g"], "v", 5).collect():
        got.setdefault(r["g"], []).append((r["probability"], r["theoretical"], r["fitted"], r["sample"]))
    assert set(got) == set(VALUES) - {"none"}
    for g, points in got.items():
        vs = real(VALUES[g])
        assert sorted(p for p, *_ in points) == plotting_positions(5)
        for p, z, fitted, sample in points:
            assert z == pytest.approx(statistics.NormalDist().inv_cdf(p), abs=1e-12)
            assert sample == pytest.approx(quantile(vs, p))
            if len(vs) == 1:
                assert fitted is None
            else:
                assert fitted == pytest.approx(statistics.mean(vs) + z * statistics.stdev(vs))


def test_density(table):
    points, got = 40, {}
    for r in density(table, ["g"], "v", points).collect():
        got.setdefault(r["g"], []).append((r["at"], r["density"]))
    assert set(got) == set(VALUES) - {"none", "one"}
    for g, found in got.items():
        vs, found = real(VALUES[g]), sorted(found)
        sd = statistics.stdev(vs)
        width = min(sd, (quantile(vs, 0.75) - quantile(vs, 0.25)) / 1.34) or sd or abs(vs[0]) or 1.0
        bw = 0.9 * width * len(vs) ** -0.2
        begin = vs[0] - 3 * bw
        step = (vs[-1] - vs[0] + 6 * bw) / (points - 1)
        assert [x for x, _ in found] == pytest.approx([begin + i * step for i in range(points)])
        # The kernel over every value, not over bins: close, as a bin is a fraction of the bandwidth.
        for x, d in found:
            plain = sum(statistics.NormalDist(v, bw).pdf(x) for v in vs) / len(vs)
            assert d == pytest.approx(plain, abs=0.05 / bw if step < bw else 1 / bw)
        if step < bw:
            assert sum(d for _, d in found) * step == pytest.approx(1.0, abs=0.01)


def test_density_and_points_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert density(none, ["g"], "v").collect() == [] and qq_points(none, ["g"], "v").collect() == []


AUDITED = "Year int, Crop string, M_P2 double, M_P2_qcApplied string, M_P2_qcResult string, M_P2_qcPhrase string, N_P2 double"


def test_outliers_are_emptied_and_audited(spark):
    rows = [(2000, "WW", float(v), "000001", "000000", None, 1.0) for v in [*range(10, 20), 90]]
    rows += [(2000, "WW", None, "000011", "000010", "kept", 1.0)]
    rows += [(2001, None, 5.0, "000001", "000000", None, None), (2001, None, 6.0, "000001", "000000", "told", None)]
    df = init_audit(spark.createDataFrame(rows, AUDITED), ["Year", "Crop"])
    removed, rules = outliers_removed(df, ["Year", "Crop"], ["M_P2", "N_P2"])
    bounds = {(r["Year"], r["Crop"], r["FieldName"]): (r["Lower"], r["Upper"]) for r in rules.collect()}
    assert bounds[2000, "WW", "M_P2"] == (12.5 - 15, 17.5 + 15) and bounds[2001, None, "M_P2"] == (5.25 - 1.5, 5.75 + 1.5)
    assert (2001, None, "N_P2") not in bounds
    out = removed.where("M_P2 IS NULL AND M_P2_qcResult <> '000010'").collect()
    assert [(r["M_P2_qcApplied"], r["M_P2_qcResult"]) for r in out] == [("001001", "001000")]
    assert out[0]["M_P2_qcPhrase"] == (
        "(Outlier) Value M_P2 is outside of bounds [-2.500000, 32.500000]; (Assurance) Previous val: 90.000000, reason: outlier"
    )
    rest = removed.where("M_P2 IS NOT NULL").collect()
    assert len(rest) == 12 and {r["M_P2_qcResult"] for r in rest} == {"000000"}
    null = removed.where("M_P2_qcResult = '000010'").first()
    assert (null["M_P2_qcApplied"], null["M_P2_qcPhrase"]) == ("001011", "kept")
    lone = removed.where("Year = 2001").collect()
    assert {r["N_P2_qcApplied"] for r in lone} == {"000001"}, "no rule, no check"


def test_fence_rules_can_be_edited_before_they_are_applied(spark):
    df = init_audit(spark.createDataFrame([(1, "x", float(i)) for i in range(9)], "Year int, Crop string, M_P2 double"), ["Year", "Crop"])
    rules = fence_rules(df, ["Year", "Crop"], ["M_P2"]).withColumn("Upper", F.lit(6.5))
    failed = fence_check(df, rules, ["Year", "Crop"], ["M_P2"]).where("M_P2_qcResult = '001000'")
    assert sorted(r["M_P2"] for r in failed.collect()) == [7.0, 8.0]
