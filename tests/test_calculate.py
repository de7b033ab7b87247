"""Calculated measures: one hand-worked row per year window and sampling mode."""

import pytest

from stubble.operators.calculate import calculate, ordered, sampling_mode
from stubble.operators.checks import split_counts
from stubble.operators.columns import add_level
from stubble.operators.qc import init_audit
from stubble.functions.naming import DIMENSIONS
from stubble.sources.tables import SAMPLE_COLUMNS, sample_schema

BASE = {c: None for c in SAMPLE_COLUMNS}
MASSES = {
    "GrainMassWet": 100.0,
    "GrainMassAirDry": 90.0,
    "GrainMassWetInGrainSample": 60.0,
    "GrainMassAirDryInGrainSample": 54.0,
    "BiomassWet": 200.0,
    "BiomassAirDry": 170.0,
    "GrainMassWetInBiomassSample": 40.0,
    "GrainMassAirDryInBiomassSample": 30.0,
    "ResidueMassWetSubsample": 50.0,
    "ResidueMassAirDrySubsample": 40.0,
}


def sample(id2, year, grain_area, biomass_area, **other):
    return {**BASE, **MASSES, "ID2": id2, "HarvestYear": year, "GrainSampleArea": grain_area, "BiomassSampleArea": biomass_area, **other}


ROWS = [
    sample(1, 1999, 2.0, 0.0),
    sample(2, 2009, None, 2.0),
    sample(3, 2005, 2.0, 2.0),
    sample(4, 2005, 0.0, None),
    sample(5, 2005, -1.0, 2.0),
    sample(6, 1998, 2.0, 0.0),
    sample(7, 2010, 0.0, 2.0),
    sample(8, 2010, 2.0, 2.0),
    sample(9, 2011, 2.0, 0.0),
    sample(10, 2016, 0.0, 2.0),
    sample(11, 2017, 0.0, 2.0),
    sample(12, 2003, None, 2.0, BiomassWet=0.0, GrainMassWetInBiomassSample=0.0),
]


@pytest.fixture(scope="module")
def result(spark):
    raw = spark.createDataFrame([tuple(r[c] for c in SAMPLE_COLUMNS) for r in ROWS], sample_schema())
    df = calculate(add_level(raw, 1))
    return {r["ID2"]: r.asDict() for r in df.collect()}


def shown(row):
    return {
        "wet": row["GrainYieldWet_P2"],
        "dry": row["GrainYieldAirDry_P2"],
        "moist": row["GrainMoistureProportionPartial_P2"],
        "res_wet": row["ResidueMassWet_P2"],
        "res_dry": row["ResidueMassAirDry_P2"],
        "res_wet_area": row["ResidueMassWetPerArea_P2"],
        "res_dry_area": row["ResidueMassAirDryPerArea_P2"],
    }


NOTHING = dict.fromkeys(["wet", "dry", "moist", "res_wet", "res_dry", "res_wet_area", "res_dry_area"])


@pytest.mark.parametrize(
    "id2, expected",
    [
        (1, {"wet": 30.0, "dry": 27.0, "moist": 0.1}),
        (2, {"wet": 20.0, "dry": 15.0, "moist": 0.25, "res_wet": 160.0, "res_dry": 128.0, "res_wet_area": 80.0, "res_dry_area": 64.0}),
        (3, {"wet": 25.0, "dry": 22.5, "moist": 0.1, "res_wet": 160.0, "res_dry": 128.0, "res_wet_area": 80.0, "res_dry_area": 64.0}),
        (4, {}),
        (7, {"wet": 50.0, "dry": 45.0, "moist": 0.1, "res_wet": 100.0, "res_dry": 80.0, "res_wet_area": 50.0, "res_dry_area": 40.0}),
        (8, {"moist": 0.1, "res_wet": 100.0, "res_dry": 80.0, "res_wet_area": 50.0, "res_dry_area": 40.0}),
        (9, {"wet": 50.0, "res_wet": 100.0}),
        (10, {"dry": 45.0, "res_dry": 80.0, "res_dry_area": 40.0}),
        (12, {"wet": 0.0, "dry": 15.0}),
    ],
)
def test_window_and_mode(result, id2, expected):
    got = shown(result[id2])
    assert got == pytest.approx({**NOTHING, **expected}, nan_ok=True)


def test_masses_of_single_samples_replace_totals(result):
    assert (result[1]["GrainMassWet_P1"], result[1]["GrainMassAirDry_P1"]) == (60.0, 54.0)
    assert (result[2]["GrainMassWet_P1"], result[2]["GrainMassAirDry_P1"]) == (40.0, 30.0)
    assert (result[3]["GrainMassWet_P1"], result[3]["GrainMassWetInGrainSample_P2"]) == (100.0, 60.0)
    assert result[3]["GrainMassAirDryInGrainSample_P2"] == pytest.approx(54.0)
    assert result[3]["GrainMassAirDryInBiomassSample_P2"] == pytest.approx(36.0)


def test_rows_left_out(spark, result):
    assert set(result) == {1, 2, 3, 4, 7, 8, 9, 10, 12}
    raw = spark.createDataFrame([tuple(r[c] for c in SAMPLE_COLUMNS) for r in ROWS], sample_schema())
    counts = split_counts(add_level(raw, 1)).first().asDict()
    assert counts == {"rows_total": 12, "rows_outside_windows": 2, "rows_without_mode": 1, "rows_kept": 9}


def test_mode_of_null_and_zero_areas(spark):
    rows = [(None, None), (0.0, None), (1.0, None), (None, 1.0), (1.0, 1.0), (-1.0, 1.0)]
    df = spark.createDataFrame(rows, "g double, b double")
    got = [r[0] for r in df.select(sampling_mode("g", "b")).collect()]
    assert got == ["neither", "neither", "grain", "biomass", "both", None]


def test_published_order(spark):
    raw = spark.createDataFrame([tuple(ROWS[0][c] for c in SAMPLE_COLUMNS)], sample_schema())
    df = ordered(calculate(init_audit(add_level(raw, 1), DIMENSIONS)))
    at = df.columns.index("CropExists_P1")
    assert df.columns[at + 1 : at + 4] == ["CropExists_P1_qcApplied", "CropExists_P1_qcResult", "CropExists_P1_qcPhrase"]
    assert df.columns[-1] == "Comments" and "GrainYieldWet_P2_qcApplied" not in df.columns
