"""The yearly harmonisers, each over sheets made of orders and a field of one point per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from stubble.plans import harvests as h
from stubble.queries.base import S, query, r, rounded, samples, table

# A customer's point: its number is the grid column, a letter the row.
_ROW = "chr(CAST(65 + (c + 9) % 25 AS INT))"
_FIELD = """pts AS (SELECT CAST(c_custkey AS BIGINT) AS pid, CAST(c_custkey AS INT) AS pc,
    chr(CAST(65 + (c_custkey + 9) % 25 AS INT)) AS pr, c_custkey * 0.5 AS X, c_nationkey * 1.5 AS Y FROM customer)"""
_BAGS = f"""o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, CAST(o_totalprice AS DOUBLE) AS p,
    CASE WHEN o_orderstatus = 'P' THEN '-' ELSE chr(CAST(65 + (o_custkey + 9) % 25 AS INT)) END AS letter,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'SC' WHEN '4-NOT SPECIFIED' THEN NULL WHEN '5-LOW' THEN 'SL' ELSE 'WW' END
      AS crop, o_orderdate FROM orders)"""


def letter(number):
    return F.chr((F.lit(65) + (number + 9) % 25).cast("int"))


def field(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        (key * 0.5).alias("X"),
        (F.col("c_nationkey") * 1.5).alias("Y"),
        key.cast("bigint").alias("ID2"),
        letter(key).alias("Row2"),
        key.cast("int").alias("Column"),
    )


def bags(spark, sf_dir):
    """An order as a weighed bag: number, point, status, mass and crop."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    known = F.when(priority == "1-URGENT", "SC").when(priority == "5-LOW", "SL").when(priority != "4-NOT SPECIFIED", "WW")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("c"),
        status.alias("st"),
        F.col("o_totalprice").cast("double").alias("p"),
        F.when(status == "P", "-").otherwise(letter(F.col("o_custkey"))).alias("letter"),
        known.alias("crop"),
        "o_orderdate",
    )


def _some(condition: str, value):
    """A value where a condition on the bag holds."""
    return F.when(F.expr(condition), value)


def _areas(biomass: str, grain: str, area: str) -> str:
    neither = f"{biomass} IS NULL AND {grain} IS NULL"
    return (
        f"CASE WHEN {neither} THEN NULL WHEN {biomass} IS NULL THEN {area} ELSE 0 END::DOUBLE AS GrainSampleArea, "
        f"CASE WHEN {neither} THEN NULL WHEN {biomass} IS NOT NULL THEN {area} ELSE 0 END::DOUBLE AS BiomassSampleArea"
    )


# ---- first years ---------------------------------------------------------------

_CROPS = ["winter wheat", "Winter Canola", "FALLOW", "Alfalfa", "SW", "spring pea"]
_CODED = "CASE c WHEN 'winter wheat' THEN 'WW' WHEN 'Winter Canola' THEN 'WC' WHEN 'Alfalfa' THEN 'AL' WHEN 'spring pea' THEN 'SP' ELSE c END"
_FIRST = f"""{S}, {_FIELD}, legacy AS (SELECT s.*, CASE o_orderstatus WHEN 'F' THEN 'grid points' WHEN 'O' THEN 'Grid Points'
      ELSE 'other' END AS project, s.HarvestYear + 10 AS yr, CAST(o_custkey AS INT) AS col,
    chr(CAST(65 + (o_custkey + 9) % 25 AS INT)) AS letter, CASE WHEN s.ID2 % 2 = 0 THEN 'A' ELSE 'B' END AS fld,
    s.ID2 % 5 AS strip, s.ID2 % 400 AS place, o_totalprice / 3000 AS n0, o_totalprice / 5000 AS c0, o_orderstatus
  FROM s JOIN orders ON o_orderkey = s.ID2),
again AS (SELECT CAST(2002 + c_custkey % 7 AS INT) AS ay, CAST(c_custkey AS INT) AS ac,
    chr(CAST(65 + (c_custkey + 9) % 25 AS INT)) AS ar,
    (['winter wheat', 'Winter Canola', 'FALLOW', 'Alfalfa', 'SW', 'spring pea'])[c_custkey % 6 + 1] AS c,
    CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 130 AS DOUBLE) END AS c1,
    CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 9 AS DOUBLE) END AS n1 FROM customer),
mixed AS (SELECT *, CASE WHEN n1 > 0 AND n1 <= 100 THEN n1 WHEN n0 > 0 AND n0 <= 100 THEN n0 END AS nf,
    CASE WHEN c1 > 0 AND c1 <= 100 THEN c1 WHEN c0 > 0 AND c0 <= 100 THEN c0 END AS cf,
    coalesce(GrainSampleArea > 0 AND BiomassSampleArea > 0, false) AS two
  FROM legacy LEFT JOIN again ON ay = yr AND ac = col AND ar = letter WHERE lower(project) = 'grid points')"""


def first_sheets(spark, sf_dir):
    """The legacy sheet and one re-analysed sheet."""
    s, key = samples(spark, sf_dir), F.col("ID2")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ID2"), "o_custkey", "o_orderstatus", "o_totalprice")
    joined, status = s.join(orders, "ID2"), F.col("o_orderstatus")
    legacy = joined.select(
        F.when(status == "F", "grid points").when(status == "O", "Grid Points").otherwise("other").alias("Project"),
        (F.col("HarvestYear") + 10).alias("Year"),
        F.col("o_custkey").cast("string").alias("Column"),
        letter(F.col("o_custkey")).alias("Row Letter"),
        F.when(key % 2 == 0, "A").otherwise("B").alias("Field"),
        (key % 5).cast("double").alias("Strip"),
        (key % 400).cast("double").alias("Sample Location ID"),
        (F.col("o_totalprice") / 3000).alias(h.N_LEGACY),
        (F.col("o_totalprice") / 5000).alias(h.C_LEGACY),
        F.col("GrainSampleArea").alias(h.GRAIN_AREA),
        F.col("BiomassSampleArea").alias(h.RESIDUE_AREA),
        F.col("GrainMassWet").alias("Non-Residue Grain Wet Weight (grams)"),
        F.col("GrainMassAirDry").alias("Non-Residue grain dry weight (grams)"),
        F.col("BiomassWet").alias(h.BIOMASS_WET),
        F.col("GrainMassWetInBiomassSample").alias(h.GRAIN_WET_IN_RESIDUE),
        F.col("GrainMassAirDryInBiomassSample").alias("Residue sample Grain Dry Weight (grams)"),
        F.col("ResidueMassWetSubsample").alias(h.SUB_WET),
        F.col("ResidueMassAirDrySubsample").alias(h.SUB_DRY),
        F.col("GrainMassWet").alias("total grain yield wet(grams)"),
        F.col("GrainMassAirDry").alias(h.TOTAL_DRY),
        F.col("GrainSampleArea").alias(h.TOTAL_AREA),
        *[F.lit(0.5).alias(c) for c in ("Grain Sulfur %...12", "Residue Carbon %", "Residue Nitrogen %", "Residue Sulfur %")],
        F.when(key % 3 == 0, status).alias("Grain Harvest Comments"),
        F.lit("residue").alias("Residue Sample Comments"),
    )
    number = F.col("c_custkey")
    again = table(spark, sf_dir, "customer").select(
        (F.lit(2002) + number % 7).alias("Year"),
        number.cast("string").alias("COLUMN"),
        letter(number).alias("ROW2"),
        F.get(F.array(*map(F.lit, _CROPS)), (number % 6).cast("int")).alias("Crop"),
        F.lit("80").alias("Total grain weight (dry) (g)"),
        F.when(number % 4 == 0, "na").otherwise((number % 130).cast("string")).alias("SW (%C)"),
        F.when(number % 3 == 0, None).otherwise((number % 9).cast("string")).alias("SW (%N)"),
        F.lit("12").alias("SW Protein"),
    )
    return legacy, h.reanalysis(again)


@query(f"""WITH {_FIRST}, moved AS (SELECT * REPLACE (
    CASE WHEN yr = 2008 AND place = 338 THEN 'H' WHEN yr = 2008 AND place = 192 THEN NULL ELSE letter END AS letter,
    CASE WHEN yr = 2008 AND place = 338 THEN 23 WHEN yr = 2008 AND place = 192 THEN NULL ELSE col END AS col,
    CASE WHEN yr = 2008 AND place = 338 THEN 2 ELSE strip END AS strip) FROM mixed),
  coded AS (SELECT *, {_CODED} AS code FROM moved JOIN pts ON pc IS NOT DISTINCT FROM col AND pr IS NOT DISTINCT FROM letter
    WHERE lower(c) <> 'fallow')
SELECT CAST(yr AS INT) AS HarvestYear, pid AS ID2, {r("X")} AS Longitude, {r("Y")} AS Latitude,
  CASE WHEN yr = 2004 AND fld = 'A' AND strip = 3 OR yr = 2008 AND fld = 'A' AND strip = 4 THEN 'SC' ELSE code END AS Crop,
  {r("GrainSampleArea")} AS GrainSampleArea, {r("BiomassSampleArea")} AS BiomassSampleArea,
  {r("CASE WHEN NOT two THEN GrainMassWet END")} AS GrainMassWetInGrainSample,
  {r("CASE WHEN two THEN GrainMassWet END")} AS GrainMassWet, {r("CASE WHEN two THEN GrainMassAirDry END")} AS GrainMassAirDry,
  {r("BiomassWet")} AS BiomassWet, {r("CASE WHEN NOT two THEN GrainMassAirDryInBiomassSample END")} AS GrainMassAirDryInBiomassSample,
  {r("ResidueMassWetSubsample")} AS ResidueMassWetSubsample, {r("nf")} AS GrainNitrogen, {r("cf")} AS GrainCarbon,
  CASE WHEN ID2 % 3 = 0 THEN o_orderstatus ELSE 'residue' END AS Comments FROM coded""")
def harmonise_first_years(spark, sf_dir):
    """1999-2009: two sources, masses kept by sampling mode, points and crops put right."""
    out = h.harvest_1999_2009(*first_sheets(spark, sf_dir), field(spark, sf_dir))
    return rounded(
        out.select(
            "HarvestYear", "ID2", "Longitude", "Latitude", "Crop", "GrainSampleArea", "BiomassSampleArea",
            "GrainMassWetInGrainSample", "GrainMassWet", "GrainMassAirDry", "BiomassWet", "GrainMassAirDryInBiomassSample",
            "ResidueMassWetSubsample", "GrainNitrogen", "GrainCarbon", "Comments",
        )
    )


_RESIDUE = "nullif(BiomassWet, 0) - GrainMassWetInBiomassSample"
_MOIST = "(nullif(ResidueMassWetSubsample, 0) - nullif(ResidueMassAirDrySubsample, 0)) / nullif(ResidueMassWetSubsample, 0)"


@query(f"""WITH {_FIRST}, l AS (SELECT * FROM mixed FULL JOIN pts ON pc = col AND pr = letter),
  x AS (SELECT *, ({_RESIDUE}) * (1 - {_MOIST}) AS dry FROM l)
SELECT CAST(yr AS INT) AS Year, pid AS ID2, {r("X")} AS X, {r("nf")} AS GrainNFinal,
  {r("CASE WHEN GrainMassAirDry > 0 THEN GrainMassAirDry END / nullif(GrainSampleArea, 0)")} AS GrainYieldDryPerArea,
  {r("dry")} AS ResidueMassDry, {r("dry / nullif(BiomassSampleArea, 0)")} AS ResidueMassDryPerArea FROM x""")
def harmonise_first_years_uncorrected(spark, sf_dir):
    """1999-2009 as recorded, residue calculated in place; points without a sample stay."""
    out = h.legacy_uncorrected(*first_sheets(spark, sf_dir), field(spark, sf_dir))
    columns = ["Year", "ID2", "X", "GrainNFinal", "GrainYieldDryPerArea", "ResidueMassDry", "ResidueMassDryPerArea"]
    return rounded(out.select(*columns))


# ---- single years ---------------------------------------------------------------


def _text_2011(spark, sf_dir):
    price = F.col("p").cast("string")
    return bags(spark, sf_dir).select(
        _some("k % 4 <> 0", F.col("k").cast("string")).alias("UID"),
        _some("k % 10 <> 3", F.col("letter")).alias("Row"),
        F.col("c").cast("string").alias("Column"),
        F.concat(F.lit("b"), "k").alias("Barcode"),
        F.lit(2011.0).alias("Year"),
        F.col("crop").alias("Current Crop"),
        F.lit(2.0).alias("Area (m2)"),
        (F.col("p") / 1000).alias("ProtDM"),
        *[F.lit(1.0).alias(c) for c in ("Moisture", "StarchDM", "WGlutDM")],
        _some("k % 5 <> 0", F.when(F.col("k") % 7 == 0, "lost").otherwise(price)).alias("Total Residue and Grain Wet (g)"),
        _some("k % 3 <> 0", F.when(F.col("k") % 11 == 0, "spilt").otherwise(price)).alias("Total Grain Wet (g)"),
        F.when(F.col("k") % 13 == 0, "ns").otherwise("60.5").alias("Test weight"),
    )


_2011 = f"""{_FIELD}, {_BAGS}, t AS (SELECT *, CASE WHEN k % 5 <> 0 AND k % 7 <> 0 THEN p END AS bio,
    CASE WHEN k % 3 <> 0 AND k % 11 <> 0 THEN p END AS grain,
    CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN 'Residue note: lost ' ELSE '' END
    || CASE WHEN k % 3 <> 0 AND k % 11 = 0 THEN 'Grain note: spilt' ELSE '' END
    || CASE WHEN k % 13 = 0 THEN 'NIR note: ns' ELSE '' END AS note,
    CASE WHEN k % 10 <> 3 THEN letter END AS place FROM o WHERE k % 4 <> 0 OR k % 10 <> 3),
  l AS (SELECT * FROM t FULL JOIN pts ON pc = c AND pr = place)"""


@query(f"""WITH {_2011} SELECT CASE WHEN k IS NOT NULL THEN 2011 END AS HarvestYear, pid AS ID2, {r("X")} AS Longitude,
  CASE WHEN k IS NOT NULL THEN 'B' || k END AS SampleID, crop AS Crop, {r("grain")} AS GrainMassWet, {r("bio")} AS BiomassWet,
  {_areas("bio", "grain", "2.0")}, {r("p / 1000")} AS GrainProtein,
  CASE WHEN k % 13 <> 0 THEN 60.5::DOUBLE END AS GrainTestWeight, coalesce(note, '') AS Comments FROM l""")
def harmonise_2011(spark, sf_dir):
    """Two files that agree, notes in number cells, areas by what was weighed."""
    sheet = _text_2011(spark, sf_dir)
    out = h.harvest_2011(sheet, field(spark, sf_dir), sheet)
    return rounded(
        out.select(
            "HarvestYear", "ID2", "Longitude", "SampleID", "Crop", "GrainMassWet", "BiomassWet", "GrainSampleArea",
            "BiomassSampleArea", "GrainProtein", "GrainTestWeight", "Comments",
        )
    )


@query(f"""WITH {_FIELD}, {_BAGS}, t AS (SELECT *, CASE WHEN k % 3 <> 0 THEN p END AS grain, CASE WHEN k % 2 = 0 THEN p * 2 END AS bio
    FROM o WHERE k % 4 <> 0 OR k % 10 <> 3),
  l AS (SELECT * FROM t FULL JOIN pts ON pc = c AND pr = CASE WHEN k % 10 <> 3 THEN letter END)
SELECT 2012 AS HarvestYear, CASE WHEN k % 4 <> 0 THEN CAST(k AS BIGINT) END AS ID2, {r("Y")} AS Latitude,
  CASE WHEN k IS NOT NULL THEN 'B' || k END AS SampleID, CASE crop WHEN 'SL' THEN 'GB' ELSE crop END AS Crop,
  {r("grain")} AS GrainMassWet, {r("bio")} AS BiomassWet, {_areas("bio", "grain", "2.0")},
  CASE WHEN k % 6 <> 0 THEN 55.0::DOUBLE END AS GrainTestWeight,
  CASE WHEN k IS NOT NULL THEN CASE WHEN k % 6 = 0 THEN 'TestWeight note: low ' ELSE '' END
    || CASE WHEN k % 8 = 1 THEN 'Sample note: ' || st ELSE '' END END AS Comments FROM l""")
def harmonise_2012(spark, sf_dir):
    """The sheet's own id beside the point's, remarks of an unnamed column, one code renamed."""
    sheet = bags(spark, sf_dir).select(
        _some("k % 4 <> 0", F.col("k").cast("string")).alias("ID2"),
        _some("k % 10 <> 3", F.col("letter")).alias("ROW2"),
        F.col("c").cast("string").alias("COLUMN"),
        F.concat(F.lit("b"), "k").alias("Barcode"),
        F.col("crop").alias("Crop"),
        F.lit(2.0).alias("Area (m2)"),
        _some("k % 3 <> 0", F.col("p")).alias("Grain Weight Wet (g)"),
        _some("k % 3 <> 0", F.col("p") / 2).alias("Grain Weight Dry (g)"),
        _some("k % 2 = 0", F.col("p") * 2).alias("Total Biomass Wet (g)"),
        F.when(F.col("k") % 6 == 0, "low").otherwise("55").alias("Test Weight"),
        _some("k % 8 = 1", F.col("st")).alias("...24"),
        *[F.lit(1.0).alias(c) for c in ("Protein", "Moisture", "Starch", "Gluten")],
    )
    out = h.harvest_2012(sheet, field(spark, sf_dir))
    return rounded(
        out.select(
            "HarvestYear", "ID2", "Latitude", "SampleID", "Crop", "GrainMassWet", "BiomassWet", "GrainSampleArea",
            "BiomassSampleArea", "GrainTestWeight", "Comments",
        )
    )


@query(f"""WITH {_BAGS}, t AS (SELECT *, CASE WHEN k % 3 <> 0 THEN p END AS grain,
    CASE WHEN k % 5 = 0 AND k % 15 <> 0 THEN p * 2 END AS bio FROM o WHERE k % 11 <> 0)
SELECT 2013 AS HarvestYear, c AS ID2, 'S' || k AS SampleID, crop AS Crop, {r("grain")} AS GrainMassAirDry, {r("bio")} AS BiomassAirDry,
  {_areas("bio", "grain", "2.0")}, CASE WHEN k % 2 = 0 THEN CAST(k % 70 AS DOUBLE) END AS GrainNitrogen,
  CASE WHEN k % 2 = 0 THEN 40.5::DOUBLE END AS GrainCarbon, CASE WHEN k % 5 = 0 THEN 0.5::DOUBLE END AS ResidueNitrogen,
  st AS Comments FROM t""")
def harmonise_2013(spark, sf_dir):
    """The yield sheet with distinct grain and residue analyses by sample id."""
    rows, key = bags(spark, sf_dir), F.col("k")
    yields = rows.select(
        F.lit(2013.0).alias("Year"),
        F.col("crop").alias("Crop"),
        F.col("c").alias("ID2"),
        F.lit(2.0).alias("Area"),
        _some("k % 11 <> 0", F.concat(F.lit("s"), key)).alias("SampleID"),
        _some("k % 3 <> 0", F.col("p")).alias("GrainWeightWet"),
        F.col("st").alias("Notes"),
        *[F.lit(1.0).alias(c) for c in ("Longitude", "Latitude", "Protein", "Moisture", "Starch", "WGlutDM", "TestWeight")],
    )
    lab = rows.where("k % 2 = 0").select(
        F.concat(F.lit("S"), key).alias("Project"), F.concat((key % 70).cast("string"), F.lit(" !")).alias("N%"), F.lit(40.5).alias("C%")
    )
    twice = lab.unionByName(lab.withColumn("N%", F.regexp_replace("N%", " !", "")))
    grain = h.analyses((twice, "Project", None, {"N%": "GrainNitrogen", "C%": "GrainCarbon"}))
    left = rows.where("k % 5 = 0").select(
        F.concat(F.lit("s"), key, F.lit("_Res")).alias("A"),
        F.when(key % 15 == 0, "na").otherwise((F.col("p") * 2).cast("string")).alias("C"),
        F.lit("0.5").alias("E"),
        F.lit("41").alias("F"),
    )
    residue = h.analyses((left, "A", "_Res", {"C": "BiomassAirDry", "E": "ResidueNitrogen", "F": "ResidueCarbon"}))
    out = h.harvest_2013(yields, grain, residue)
    return rounded(
        out.select(
            "HarvestYear", "ID2", "SampleID", "Crop", "GrainMassAirDry", "BiomassAirDry", "GrainSampleArea",
            "BiomassSampleArea", "GrainNitrogen", "GrainCarbon", "ResidueNitrogen", "Comments",
        )
    )


_MASS = "floor(p / 100000) * 100"
_TESTS = ["true", "protein IS NOT NULL", "saved >= 42003", "bag IS NOT NULL"]


def _tier(i: int, test: str) -> str:
    """Bags of a tier per point: count, kinds, masses, and the first one."""
    kinds = "count(DISTINCT (c, letter, code, crop, mass, protein, saved, bag, total, note))"
    return f"t{i} AS (SELECT pid, count(*) AS n, {kinds} AS kinds, count(DISTINCT mass) AS masses, count(mass) AS weighed, arg_min((mass, protein, code, crop, note, X), pos) AS pick FROM l WHERE pid IS NOT NULL AND {test} GROUP BY pid)"


_PASS = "CASE WHEN t{i}.n = 1 OR (t{i}.n > 1 AND ((t{i}.n - t{i}.kinds) * 2 = t{i}.n OR t{i}.masses = 1)) THEN t{i}.pick END"
_2014 = f"""{_FIELD}, {_BAGS}, b AS (SELECT c, letter, crop, k AS pos, {_MASS} AS mass, CASE WHEN crop = 'SC' THEN k % 40 + 0.5 END AS protein,
    datediff('day', DATE '1900-01-01', CAST(o_orderdate AS DATE)) + 7305 AS saved, CASE WHEN st = 'O' THEN 10.0 END AS bag,
    CASE WHEN k % 2 = 0 THEN p * 2 END AS total, 'b' || k % 3 AS code, st AS note FROM o),
  l AS (SELECT * FROM b FULL JOIN pts ON pc = c AND pr = letter),
  {", ".join(_tier(i, t) for i, t in enumerate(_TESTS))},
  chosen AS (SELECT t0.pid, CASE WHEN t0.n = 1 THEN t0.pick ELSE coalesce({", ".join(_PASS.format(i=i) for i in (1, 2, 3))}) END AS pick
    FROM t0 LEFT JOIN t1 ON t1.pid = t0.pid LEFT JOIN t2 ON t2.pid = t0.pid LEFT JOIN t3 ON t3.pid = t0.pid),
  bios AS (SELECT pid AS bp, coalesce(total, p3 - bag) AS bio FROM (SELECT *, mass * 3 AS p3 FROM l) WHERE pid IS NOT NULL
    AND coalesce(total, p3 - bag) IS NOT NULL),
  reps AS (SELECT pid, pick[1] AS mass, pick[2] AS protein, pick[3] AS code, pick[4] AS crop, pick[5] AS note, pick[6] AS X, bio
    FROM chosen LEFT JOIN bios ON bp = pid WHERE pick IS NOT NULL)"""


def replicates_2014(spark, sf_dir):
    """Bags of 2014, several per point."""
    mass = F.floor(F.col("p") / 100000) * 100.0
    return bags(spark, sf_dir).select(
        F.lit(True).alias("ShouldKeep"),
        F.lit(1.0).alias("ID2"),
        F.col("letter").alias("Row2"),
        F.col("c").alias("Col"),
        F.concat(F.lit("b"), F.col("k") % 3).alias("BarcodeFinal"),
        F.col("crop").alias("Crop"),
        mass.alias("TotalGrain.g."),
        _some("k % 2 = 0", F.col("p") * 2).alias("TotalBiomass.g."),
        (mass * 3).alias("Tota.Biomass.g..bag"),
        _some("st = 'O'", F.lit(10.0)).alias("TareBag.g..1"),
        (F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1900-01-01").cast("date")) + 7305).alias("LastSaved"),
        _some("crop = 'SC'", F.col("k") % 40 + F.lit(0.5)).alias("protein"),
        *[F.lit(1.0).alias(c) for c in ("moisture", "starch", "gluten", "testWeight")],
        F.col("st").alias("NOTES"),
        F.lit(None).cast("string").alias("Notes2"),
        F.lit("x").alias("Notes3"),
        F.col("k").alias("at"),
    )


_NOTE = "coalesce(note, 'NA') || ' | NA | ' || CASE WHEN code IS NULL THEN 'NA' ELSE 'x' END"


@query(f"""WITH {_2014} SELECT 2014 AS HarvestYear, pid AS ID2, {r("X")} AS Longitude, code AS SampleID, crop AS Crop,
  {r("mass")} AS GrainMassAirDry, {r("bio")} AS BiomassAirDry, {_areas("bio", "mass", "2.0")}, {r("protein")} AS GrainProtein,
  {_NOTE} AS Comments FROM reps""")
def harmonise_2014_replicates(spark, sf_dir):
    """One bag per point by priority tiers, with every biomass that was weighed there."""
    out = h.replicate_table(replicates_2014(spark, sf_dir), field(spark, sf_dir), ["at"])
    return rounded(
        out.select(
            "HarvestYear", "ID2", "Longitude", "SampleID", "Crop", "GrainMassAirDry", "BiomassAirDry", "GrainSampleArea",
            "BiomassSampleArea", "GrainProtein", "Comments",
        )
    )


@query(f"""WITH {_2014}, two AS (SELECT c_custkey, 'S_1_' || c_custkey || '-' || chr(CAST(65 + (c_custkey + 9) % 25 AS INT)) AS sample,
    CASE c_custkey % 3 WHEN 0 THEN 'SC' ELSE 'WW' END AS kind, CAST(c_acctbal AS DOUBLE) AS g,
    CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2.0 END AS res, CASE WHEN c_custkey % 6 = 0 THEN 'r' END AS remark
  FROM customer WHERE c_custkey % 3 < 2)
SELECT CASE WHEN sample IS NOT NULL THEN 2014 END AS HarvestYear, pid AS ID2, sample AS SampleID, kind AS Crop,
  {r("coalesce(g, mass)")} AS GrainMassAirDry, {r("coalesce(res, bio)")} AS BiomassAirDry,
  {_areas("coalesce(res, bio)", "coalesce(g, mass)", "2.0")}, {r("protein")} AS GrainProtein,
  {_NOTE} || ' | ' || coalesce(remark, 'NA') AS Comments FROM reps LEFT JOIN two ON c_custkey = pid""")
def harmonise_2014(spark, sf_dir):
    """Crop sheets whose grain and residue bags are merged, beside the chosen replicates."""
    points, key = field(spark, sf_dir), F.col("c_custkey")
    people = table(spark, sf_dir, "customer")
    code = F.concat(F.lit("S_1_"), key, F.lit("-"), letter(key))
    none = F.lit(None).cast("double")

    def sheet(rest: int, name, grain, residue, remark, at):
        rows = people.where(key % 3 == rest).select(
            name.alias("SampleID"), grain.alias("GrainMassAirDry"), residue.alias("BiomassAirDry"), remark.alias("Comments"), at.alias("at")
        )
        return h.coded_sample(rows)

    mass, text = F.col("c_acctbal").cast("double"), F.lit(None).cast("string")
    grain_bags = sheet(0, code, mass, none, text, key * 2)
    residue_bags = sheet(0, F.concat(code, F.lit("_RES")), none, key * 2.0, F.when(key % 6 == 0, "r"), key * 2 + 1)
    sheets = {"SC": grain_bags.unionByName(residue_bags), "WW": sheet(1, code, mass, none, text, key * 2)}
    chosen = h.replicate_table(replicates_2014(spark, sf_dir), points, ["at"])
    out = h.harvest_2014(sheets, chosen, points, ["at"])
    return rounded(
        out.select(
            "HarvestYear", "ID2", "SampleID", "Crop", "GrainMassAirDry", "BiomassAirDry", "GrainSampleArea",
            "BiomassSampleArea", "GrainProtein", "Comments",
        )
    )


_LATE = f"""{_BAGS}, t AS (SELECT *, CASE WHEN k % 3 <> 0 THEN p END AS grain, CASE WHEN k % 2 = 0 THEN p * 2 END AS bio,
    CASE WHEN c = 258 THEN 'SC' ELSE crop END AS crop15 FROM o)"""
_BY_CROP = "CASE WHEN {c} = 'SC' THEN 2.0 WHEN {c} <> 'SC' THEN 2.4384 ELSE 0 END"


def late_sheet(spark, sf_dir, year: int, notes: str):
    return bags(spark, sf_dir).select(
        F.lit(float(year)).alias("HarvestYear"),
        F.lit("1.5").alias("Longitude"),
        F.lit(2.0).alias("Latitude"),
        F.concat(F.lit("b"), "k").alias("Barcode"),
        F.col("c").alias("ID2"),
        F.col("crop").alias("Crop"),
        _some("k % 3 <> 0", F.col("p")).alias("GrainNetWt (g)"),
        _some("k % 2 = 0", F.col("p") * 2).alias("NetWt (g)"),
        _some("k % 4 <> 0", F.col("p") / 1000).alias("Protein (%)"),
        _some("k % 9 <> 0", F.lit(7.0)).alias("Moisture (%)"),
        F.lit(60.0).alias("Starch (%)"),
        F.lit(30.0).alias("WGlutDM"),
        F.lit(None).cast("double").alias("Oil (DM)"),
        F.lit(50.0).alias("TestWeight (g)"),
        F.col("st").alias(notes),
        "k",
    )


_SHOWN = ["HarvestYear", "ID2", "Longitude", "SampleID", "Crop", "GrainMassAirDry", "BiomassAirDry", "GrainSampleArea", "BiomassSampleArea", "GrainProtein", "GrainMoisture", "GrainOilDM", "Comments"]


@query(f"""WITH {_LATE} SELECT 2015 AS HarvestYear, c AS ID2, 1.5::DOUBLE AS Longitude, 'b' || k AS SampleID, crop15 AS Crop,
  {r("grain")} AS GrainMassAirDry, {r("bio")} AS BiomassAirDry, {_areas("bio", "grain", _BY_CROP.format(c="crop15"))},
  {r("CASE WHEN k % 4 <> 0 THEN p / 1000 END")} AS GrainProtein, CASE WHEN k % 9 <> 0 THEN 7.0::DOUBLE END AS GrainMoisture,
  CAST(NULL AS DOUBLE) AS GrainOilDM, st AS Comments FROM t""")
def harmonise_2015(spark, sf_dir):
    """Areas by the crop's way of harvest, one misplanted point."""
    sheet = late_sheet(spark, sf_dir, 2015, "Notes").drop("k")
    return rounded(h.harvest_2015(sheet).select(*_SHOWN))


@query(f"""WITH {_LATE} SELECT 2016 AS HarvestYear, c AS ID2, 1.5::DOUBLE AS Longitude, 'b' || k AS SampleID, crop AS Crop,
  {r("grain")} AS GrainMassAirDry, {r("bio")} AS BiomassAirDry, {_areas("bio", "grain", _BY_CROP.format(c="crop"))},
  {r("CASE WHEN k % 4 <> 0 THEN p / 1000 WHEN k % 2 = 0 THEN 11 END")} AS GrainProtein,
  CASE WHEN k % 9 <> 0 THEN 7.0::DOUBLE WHEN k % 2 = 1 THEN 3.0 END AS GrainMoisture,
  CASE WHEN k % 2 = 0 THEN CAST(k % 30 AS DOUBLE) END AS GrainOilDM, st AS Comments
FROM t WHERE c % 17 <> 0 AND (k % 2 = 0 OR k % 3 = 0)""")
def harmonise_2016(spark, sf_dir):
    """Sheet and two lab tables by barcode; what the sheet says comes first."""
    sheet, key = late_sheet(spark, sf_dir, 2016, "NotesValue"), F.col("k")
    sample = F.col("Barcode").alias("Sample")
    lab = [
        sheet.where(key % 2 == 0).select(sample, (key % 30).cast("double").alias("Oil (DM)"), F.lit(11.0).alias("ProtDM")),
        sheet.where((key % 2 == 1) & (key % 3 == 0)).select(sample, F.lit(3.0).alias("Moisture"), F.lit(1.0).alias("Infartec 1241 Test Weight"), F.lit(1.0).alias("StarchDM"), F.lit(1.0).alias("WGlutDM")),
    ]
    own = sheet.withColumn("ID2", _some("ID2 % 17 <> 0", F.col("ID2"))).drop("k")
    return rounded(h.harvest_2016(own, lab).select(*_SHOWN))
