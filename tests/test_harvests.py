"""Yearly harmonisation on hand-made sheets."""

import pytest
from pyspark.sql import functions as F

from stubble.plans import harvests as h
from stubble.plans.review import reconciled
from stubble.sources.tables import SAMPLE_COLUMNS


@pytest.fixture(scope="module")
def points(spark):
    rows = [(1.0, 2.0, 10, "A", 1), (1.5, 2.5, 227, "B", 2), (3.0, 4.0, 338, "H", 23), (5.0, 6.0, 258, "C", 3)]
    return spark.createDataFrame(rows, "X double, Y double, ID2 bigint, Row2 string, Column int")


def frame(spark, rows, types=None):
    """A frame from dicts; ``types`` names the columns that are not text or double."""
    columns = list(dict.fromkeys(c for r in rows for c in r))
    types = types or {}

    def kind(c):
        values = [r[c] for r in rows if r.get(c) is not None]
        return types.get(c) or ("string" if not values or isinstance(values[0], str) else "double")

    schema = ", ".join(f"`{c}` {kind(c)}" for c in columns)
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)


LEGACY = {
    "Project": "grid points",
    "Year": 1999,
    "Column": "1",
    "Row Letter": "A",
    "Field": "A",
    "Strip": 1.0,
    "Sample Location ID": 10.0,
    h.N_LEGACY: 2.0,
    h.C_LEGACY: 40.0,
    h.GRAIN_AREA: 2.0,
    h.RESIDUE_AREA: 0.0,
    "Non-Residue Grain Wet Weight (grams)": 50.0,
    "Non-Residue grain dry weight (grams)": 45.0,
    h.BIOMASS_WET: 100.0,
    h.GRAIN_WET_IN_RESIDUE: 40.0,
    "Residue sample Grain Dry Weight (grams)": 35.0,
    h.SUB_WET: 20.0,
    h.SUB_DRY: 15.0,
    "total grain yield wet(grams)": 90.0,
    h.TOTAL_DRY: 80.0,
    h.TOTAL_AREA: 4.0,
    "Grain Sulfur %...12": 0.1,
    "Residue Carbon %": 41.0,
    "Residue Nitrogen %": 0.5,
    "Residue Sulfur %": 0.2,
    "Grain Harvest Comments": None,
    "Residue Sample Comments": "late",
}


@pytest.fixture(scope="module")
def legacy(spark):
    rows = [
        LEGACY,
        {**LEGACY, "Project": "other"},
        {**LEGACY, "Year": 2001, "Column": "2", "Row Letter": "B", "Strip": 3.0, h.RESIDUE_AREA: 2.0, "Grain Harvest Comments": "early"},
        {**LEGACY, "Year": 2008, "Column": "9", "Row Letter": "Z", "Sample Location ID": 338.0, "Strip": 4.0, "Project": "Grid Points"},
        {**LEGACY, "Year": 2003, h.N_LEGACY: 0.0},
    ]
    return frame(spark, rows, {"Year": "int", "Grain Harvest Comments": "string", "Residue Sample Comments": "string"})


@pytest.fixture(scope="module")
def again(spark):
    def sheet(year, prefix, rows):
        columns = ["COLUMN", "ROW2", "Crop", "Total grain weight (dry) (g)", f"{prefix} (%C)", f"{prefix} (%N)", f"{prefix} Protein"]
        df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
        return h.reanalysis(df.withColumn("Year", F.lit(year)))

    parts = [
        sheet(1999, "SW", [("1", "A", "spring wheat", "80", "45", "150", "12")]),
        sheet(2001, "WC", [("2", "B", "winter canola", "80", None, "3", "na")]),
        sheet(2003, "SB", [("1", "A", "FALLOW", "80", "44", "1", "11")]),
        sheet(2008, "AL", [("9", "Z", "Alfalfa", "80", "44", "1", "11")]),
    ]
    return h.all_years(*parts)


def test_first_years(legacy, again, points):
    df = h.harvest_1999_2009(legacy, again, points)
    got = {r["HarvestYear"]: r.asDict() for r in df.collect()}
    assert set(got) == {1999, 2001, 2008}, "fallow and other projects are left out"
    one = got[1999]
    assert (one["Crop"], one["GrainCarbon"], one["GrainNitrogen"]) == ("SW", 45.0, 2.0), "150 percent is not valid"
    assert (one["GrainMassWetInGrainSample"], one["GrainMassWet"]) == (50.0, None)
    assert (one["Longitude"], one["ID2"], one["Comments"]) == (1.0, 10, "late")
    two = got[2001]
    assert two["Crop"] == "WP", "the misplanted point overrides the replanted strip"
    assert (two["GrainMassWet"], two["GrainMassAirDryInBiomassSample"], two["Comments"]) == (90.0, None, "early")
    moved = got[2008]
    assert (moved["ID2"], moved["Crop"]) == (338, "AL"), "reassigned to its own point and strip 2"
    assert set(df.columns) <= set(SAMPLE_COLUMNS)


def test_first_years_uncorrected(legacy, again, points):
    got = {r["Year"]: r.asDict() for r in h.legacy_uncorrected(legacy, again, points).where("Year is not null").collect()}
    assert got[1999]["GrainYieldDryPerArea"] == 20.0
    assert got[1999]["ResidueMassDry"] == pytest.approx(45.0) and got[1999]["ResidueMassDryPerArea"] is None
    assert got[2001]["ResidueMassDryPerArea"] == pytest.approx(22.5)
    assert got[2008]["ID2"] is None, "no reassignment"


def test_2010(spark, points):
    grain = frame(spark, [
        {"Bag Barcode": "gp_1", "Year": 2010.0, "Row": "A", "Column": "1", "Grain Type": "SW", "Field": "A", "Strip": 1.0, "Area (m2)": 2.0, "Total Grain Wet (g)": 9.0, "Total Grain Dry (g)": 8.0, "Comments": "c"},
        {"Bag Barcode": "gp_2", "Year": 2010.0, "Row": "B", "Column": "2", "Grain Type": "SW", "Field": "B", "Strip": 1.0, "Area (m2)": 2.0, "Total Grain Wet (g)": 7.0, "Total Grain Dry (g)": 6.0, "Comments": None},
    ], {"Comments": "string"})
    residue = frame(spark, [
        {"Bag Barcode": "GP_1", "Project": "GP", "Total Biomass Wet (g)": 20.0, "Total Grain Wet (g)": 9.0, "Residue Sub Wet (g)": 5.0, "Sub Res Dry (g)": 4.0},
        {"Bag Barcode": "gp_2", "Project": "GP", "Total Biomass Wet (g)": 20.0, "Total Grain Wet (g)": 9.0, "Residue Sub Wet (g)": 0.0, "Sub Res Dry (g)": 4.0},
        {"Bag Barcode": "gp_9", "Project": "XX", "Total Biomass Wet (g)": 20.0, "Total Grain Wet (g)": 9.0, "Residue Sub Wet (g)": 5.0, "Sub Res Dry (g)": 4.0},
    ])
    got = {r["ID2"]: r.asDict() for r in h.harvest_2010(grain, residue, points).where("HarvestYear is not null").collect()}
    assert (got[10]["Crop"], got[10]["SampleID"], got[10]["BiomassSampleArea"], got[10]["GrainSampleArea"]) == ("WW", "GP_1", 2.0, 0.0)
    assert (got[227]["Crop"], got[227]["BiomassSampleArea"], got[227]["GrainSampleArea"]) == ("SW", 0.0, 2.0)
    assert got[227]["BiomassWet"] is None and got[10]["ResidueMassAirDrySubsample"] == 4.0


def test_2011_notes(spark, points):
    base = {"UID": None, "Row": "A", "Column": "1", "Barcode": "x1", "Year": 2011.0, "Current Crop": "WW", "Area (m2)": 2.0, "ProtDM": 12.0, "Moisture": 9.0, "StarchDM": 60.0, "WGlutDM": 30.0}
    sheet = frame(spark, [
        {**base, "Total Residue and Grain Wet (g)": "lost", "Total Grain Wet (g)": "12.5", "Test weight": "ns"},
        {**base, "Row": "B", "Column": "2", "UID": "227", "Total Residue and Grain Wet (g)": "30", "Total Grain Wet (g)": None, "Test weight": "60"},
        {**base, "Row": None, "Total Residue and Grain Wet (g)": "30", "Total Grain Wet (g)": "1", "Test weight": "60"},
    ])
    got = {r["ID2"]: r.asDict() for r in h.harvest_2011(sheet, points).where("HarvestYear is not null").collect()}
    assert set(got) == {10, 227}
    assert got[10]["Comments"] == "Residue note: lost NIR note: ns"
    assert (got[10]["BiomassWet"], got[10]["GrainMassWet"], got[10]["GrainSampleArea"]) == (None, 12.5, 2.0)
    assert (got[227]["Comments"], got[227]["BiomassSampleArea"], got[227]["GrainTestWeight"]) == ("", 2.0, 60.0)
    again = sheet.withColumn("UID", F.coalesce("UID", F.lit("10")))
    own = again.where("Row is not null")
    h.harvest_2011(own, points, own)  # alike: no warning
    other = own.withColumn("Total Grain Wet (g)", F.when(F.col("UID") == "10", "99").otherwise(F.col("Total Grain Wet (g)")))
    with pytest.warns(UserWarning, match="two files differ.*Total Grain Wet"):
        h.harvest_2011(own, points, other)


def test_2012(spark, points):
    pts = points
    sheet = frame(spark, [
        {"ID2": "10", "ROW2": "A", "COLUMN": "1", "Barcode": "x", "Crop": "SL", "Area (m2)": 2.0, "Grain Weight Wet (g)": 5.0, "Grain Weight Dry (g)": 4.0, "Total Biomass Wet (g)": None, "Test Weight": "low", "...24": "wet", "Protein": 1.0, "Moisture": 2.0, "Starch": 3.0, "Gluten": 4.0},
    ], {"Total Biomass Wet (g)": "double"})
    row = h.harvest_2012(sheet, pts).where("SampleID = 'X'").first()
    assert (row["Crop"], row["HarvestYear"], row["ID2"]) == ("GB", 2012, 10)
    assert row["Comments"] == "TestWeight note: low Sample note: wet" and row["GrainSampleArea"] == 2.0


def test_2013(spark):
    base = {"Year": 2013.0, "Crop": "GB", "Longitude": 1.0, "Latitude": 2.0, "ID2": 10.0, "Area": 2.0, "Protein": 1.0, "Moisture": 1.0, "Starch": 1.0, "WGlutDM": 1.0, "TestWeight": 1.0, "Notes": "n"}
    yields = frame(spark, [{**base, "SampleID": "a", "GrainWeightWet": 5.0}, {**base, "SampleID": "b", "GrainWeightWet": 6.0}, {**base, "SampleID": None, "GrainWeightWet": 7.0}])
    cn = spark.createDataFrame([("a", "1.5 !", 40.0), ("A", "1.5", 40.0)], "Project string, `N%` string, `C%` double")
    grain = h.analyses((cn, "Project", None, {"N%": "GrainNitrogen", "C%": "GrainCarbon"}))
    res = spark.createDataFrame([("b_Res", "9", "0.5", "41")], "A string, C string, E string, F string")
    residue = h.analyses((res, "A", "_Res", {"C": "BiomassAirDry", "E": "ResidueNitrogen", "F": "ResidueCarbon"}))
    got = {r["SampleID"]: r.asDict() for r in h.harvest_2013(yields, grain, residue).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"]["GrainNitrogen"], got["A"]["GrainSampleArea"], got["A"]["GrainMassAirDry"]) == (1.5, 2.0, 5.0)
    assert (got["B"]["BiomassAirDry"], got["B"]["BiomassSampleArea"], got["B"]["ResidueCarbon"]) == (9.0, 2.0, 41.0)


REP = {"ID2": 1.0, "Row2": "A", "Col": "1", "BarcodeFinal": "b1", "Crop": "GB", "TotalGrain.g.": 5.0, "TotalBiomass.g.": None, "Tota.Biomass.g..bag": 12.0, "TareBag.g..1": 2.0, "LastSaved": 41000.0, "protein": None, "moisture": None, "starch": None, "gluten": None, "testWeight": None, "NOTES": "n", "Notes2": None, "Notes3": None}
REP_TYPES = {c: "double" for c in ("TotalBiomass.g.", "protein", "moisture", "starch", "gluten", "testWeight", "TareBag.g..1", "Tota.Biomass.g..bag")} | {"NOTES": "string", "Notes2": "string", "Notes3": "string"}


def test_2014(spark, points):
    reps = frame(spark, [
        {**REP, "o": 1.0},
        {**REP, "o": 2.0, "TotalGrain.g.": 6.0, "protein": 12.0, "Tota.Biomass.g..bag": None},
        {**REP, "o": 3.0, "Row2": "Q"},
    ], REP_TYPES)
    chosen = h.replicate_table(reps, points, ["o"])
    row = chosen.first()
    assert chosen.count() == 1 and (row["GrainMassAirDry"], row["GrainProtein"], row["BiomassAirDry"]) == (6.0, 12.0, 10.0)
    assert (row["Comments"], row["BiomassSampleArea"], row["HarvestYear"]) == ("n | NA | NA", 2.0, 2014)

    ww = h.coded_sample(frame(spark, [
        {"SampleID": "AB_8_1-A", "GrainMassAirDry": 7.0, "BiomassAirDry": None, "Comments": None, "o": 1.0},
        {"SampleID": "AB_8_1-A_RES", "GrainMassAirDry": None, "BiomassAirDry": 20.0, "Comments": "r", "o": 2.0},
    ], {"BiomassAirDry": "double", "Comments": "string"}))
    assert [tuple(r) for r in ww.select("Column", "Row2").distinct().collect()] == [(1, "A")]
    sw = h.built_sample(spark.createDataFrame([("B", 2, "S", 1.0, 2.0, "c", 3.0)], "Row2 string, Column int, Sample string, GrainMassAirDry double, BiomassAirDry double, Comments string, o double"))
    assert sw.first()["SampleID"] == "S_2-B"
    got = h.harvest_2014({"WW": ww, "SW": sw}, chosen, points, ["o"]).collect()
    assert len(got) == 1, "only points with a chosen replicate"
    row = got[0]
    assert (row["SampleID"], row["Crop"], row["GrainMassAirDry"], row["BiomassAirDry"], row["GrainProtein"]) == ("AB_8_1-A", "WW", 7.0, 20.0, 12.0)
    assert row["Comments"] == "n | NA | NA | r" and row["BiomassSampleArea"] == 2.0


def test_2015_and_2016_areas(spark):
    def sheet(year, rows):
        base = {"HarvestYear": float(year), "Longitude": "1.5", "Latitude": 2.0, "Notes": "n", "Protein (%)": None, "Moisture (%)": 1.0, "Starch (%)": 1.0, "WGlutDM": 1.0, "Oil (DM)": None, "TestWeight (g)": 1.0}
        types = {"Crop": "string", "NetWt (g)": "double", "GrainNetWt (g)": "double", "Protein (%)": "double", "Oil (DM)": "double"}
        return frame(spark, [{**base, **r} for r in rows], types)

    rows = [
        {"Barcode": "a", "ID2": 258.0, "Crop": "WW", "GrainNetWt (g)": 5.0, "NetWt (g)": None},
        {"Barcode": "b", "ID2": 1.0, "Crop": "WW", "GrainNetWt (g)": 5.0, "NetWt (g)": 9.0},
        {"Barcode": "c", "ID2": 2.0, "Crop": None, "GrainNetWt (g)": 5.0, "NetWt (g)": None},
        {"Barcode": "d", "ID2": 3.0, "Crop": "WW", "GrainNetWt (g)": None, "NetWt (g)": None},
    ]
    got = {r["SampleID"]: r for r in h.harvest_2015(sheet(2015, rows)).collect()}
    assert (got["a"]["Crop"], got["a"]["GrainSampleArea"]) == ("SC", 2.0)
    assert (got["b"]["GrainSampleArea"], got["b"]["BiomassSampleArea"]) == (0.0, 2.4384)
    assert got["c"]["GrainSampleArea"] == 0.0 and got["d"]["GrainSampleArea"] is None
    own = sheet(2016, rows).withColumnRenamed("Notes", "NotesValue")
    lab = [spark.createDataFrame([("a", 7.0, 11.0), ("b", 8.0, 12.0)], "Sample string, `Oil (DM)` double, ProtDM double")]
    lab += [spark.createDataFrame([("d", 1.0, 2.0, 3.0, 4.0)], "Sample string, Moisture double, StarchDM double, WGlutDM double, `Infartec 1241 Test Weight` double")]
    got = {r["SampleID"]: r for r in h.harvest_2016(own, lab).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"]["GrainOilDM"] == 7.0 and got["b"]["GrainProtein"] == 12.0
    assert got["d"]["GrainMoisture"] == 1.0 and got["a"]["Longitude"] == 1.5 and got["a"]["Crop"] == "WW"
    masses = "Sample string, `Grain Net Wt. (g)` double, `Net Wt. (g)` double"
    lab += [spark.createDataFrame([("b", 5.0, 9.5)], masses)]
    with pytest.warns(UserWarning, match="masses differ.*NetWt"):
        h.harvest_2016(own, lab)


def test_raw_table(spark, points):
    rows = [(1999, 10, "WW"), (1999, 227, "WW"), (2000, 10, "SW")]
    samples = spark.createDataFrame(rows, "HarvestYear int, ID2 bigint, Crop string")
    present = spark.createDataFrame([(1999, 10, 1), (2000, 10, 0)], "HarvestYear int, ID2 bigint, CropExists int")
    df = h.raw_table(samples, present, points)
    assert df.columns == list(SAMPLE_COLUMNS)
    got = {(r["HarvestYear"], r["ID2"]): (r["Crop"], r["CropExists"], r["Longitude"]) for r in df.collect()}
    assert got == {(1999, 10): ("WW", 1, None), (1999, 227): ("WW", None, None), (2000, 10): ("SW", 0, None), (2000, 227): (None, 0, 1.5)}


def test_reconciled_sources(spark):
    a = spark.createDataFrame([(i, "g", float(i)) for i in range(1, 8)] + [(8, "g", 1000.0), (9, "g", 0.0)], "i int, g string, a double")
    b = spark.createDataFrame([(1, 3.0), (8, 2.0), (9, None)], "i int, b double")
    got = {r["i"]: r["MFinal"] for r in reconciled(a, b, ["i"], ["g"], {"M": ("a", "b")}).collect()}
    assert (got[1], got[2], got[8], got[9]) == (2.0, 2.0, 2.0, None)
