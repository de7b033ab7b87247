"""Yearly harmonisation over driver tables that stand for lab sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from stubble.operators.order import first_rows
from stubble.operators.stats import means_by
from stubble.plans.harvests import harvest_2010, raw_table
from stubble.queries.base import S, query, r, rounded, samples, table

_PLACES = """p AS (SELECT n_nationkey AS pc, CAST(n_regionkey AS VARCHAR) AS pr, n_nationkey AS pid,
  n_nationkey * 1.5 AS X, n_regionkey * 2.5 AS Y FROM nation)"""


def places(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("Column"),
        F.col("n_regionkey").cast("string").alias("Row2"),
        F.col("n_nationkey").cast("bigint").alias("ID2"),
        (F.col("n_nationkey") * 1.5).alias("X"),
        (F.col("n_regionkey") * 2.5).alias("Y"),
    )


@query(f"""WITH {S}, {_PLACES}, g AS (SELECT upper('gp_' || CAST(s.ID2 AS VARCHAR)) AS b, HarvestYear,
    CASE WHEN o_orderstatus = 'F' AND c_nationkey = 1 THEN 'WW' ELSE Crop END AS Crop,
    GrainMassWet, GrainMassAirDry, c_nationkey AS col,
    CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE '2' END AS row,
    c_mktsegment AS note FROM s JOIN orders ON o_orderkey = s.ID2 JOIN customer ON c_custkey = o_custkey),
  loc AS (SELECT * FROM g FULL JOIN p ON pc = col AND pr = row),
  x AS (SELECT 'GP_' || CAST(ID2 AS VARCHAR) AS xb, BiomassWet, ResidueMassWetSubsample AS sw,
    ResidueMassAirDrySubsample AS sd FROM s WHERE HarvestYear > 1995 AND BiomassWet IS NOT NULL
    AND GrainMassWet IS NOT NULL AND ResidueMassWetSubsample > 0),
  j AS (SELECT * FROM loc FULL JOIN x ON b = xb)
SELECT HarvestYear, CAST(pid AS BIGINT) AS ID2, {r("X")} AS Longitude, {r("Y")} AS Latitude, b AS SampleID,
  Crop, CASE WHEN BiomassWet IS NULL AND GrainMassWet IS NULL THEN NULL
    WHEN BiomassWet IS NULL THEN 2.0 ELSE 0.0 END::DOUBLE AS GrainSampleArea,
  {r("GrainMassWet")} AS GrainMassWet, {r("GrainMassAirDry")} AS GrainMassAirDry,
  CASE WHEN BiomassWet IS NULL AND GrainMassWet IS NULL THEN NULL
    WHEN BiomassWet IS NULL THEN 0.0 WHEN b IS NULL THEN NULL ELSE 2.0 END::DOUBLE AS BiomassSampleArea,
  {r("BiomassWet")} AS BiomassWet, {r("sw")} AS ResidueMassWetSubsample,
  {r("sd")} AS ResidueMassAirDrySubsample, note AS Comments
FROM j WHERE pid IS NOT NULL""")
def harmonise_two_sheets(spark, sf_dir):
    """Grain and residue sheets by barcode, placed on the grid, areas from what was weighed."""
    s = samples(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID2"), "o_custkey", "o_orderstatus"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    status = F.col("o_orderstatus")
    grain = (
        s.join(orders, "ID2")
        .join(customers, F.col("c_custkey") == F.col("o_custkey"))
        .select(
            F.concat(F.lit("gp_"), F.col("ID2").cast("string")).alias("Bag Barcode"),
            F.col("HarvestYear").alias("Year"),
            F.when(status == "F", "0").when(status == "O", "1").otherwise("2").alias("Row"),
            F.col("c_nationkey").alias("Column"),
            F.col("Crop").alias("Grain Type"),
            F.when(status == "F", "A").otherwise("B").alias("Field"),
            F.col("c_nationkey").alias("Strip"),
            F.lit(2.0).alias("Area (m2)"),
            F.col("GrainMassWet").alias("Total Grain Wet (g)"),
            F.col("GrainMassAirDry").alias("Total Grain Dry (g)"),
            F.col("c_mktsegment").alias("Comments"),
        )
    )
    residue = s.select(
        F.concat(F.lit("Gp_"), F.col("ID2").cast("string")).alias("Bag Barcode"),
        F.when(F.col("HarvestYear") > 1995, "GP").otherwise("old").alias("Project"),
        F.col("BiomassWet").alias("Total Biomass Wet (g)"),
        F.col("GrainMassWet").alias("Total Grain Wet (g)"),
        F.col("ResidueMassWetSubsample").alias("Residue Sub Wet (g)"),
        F.col("ResidueMassAirDrySubsample").alias("Sub Res Dry (g)"),
    )
    return rounded(harvest_2010(grain, residue, places(spark, sf_dir)))


_SIGHT = """v AS (SELECT CAST(day(ts) AS INT) AS HarvestYear, user_id AS ID2,
    CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS GrainMassWet
  FROM events GROUP BY 1, 2)"""


@query(f"""WITH {_SIGHT}, e AS (SELECT CAST(day(ts) AS INT) AS y, user_id AS u, 1 AS x FROM events
    WHERE event_type = 'click' GROUP BY 1, 2),
  gaps AS (SELECT HarvestYear, ID2 FROM (SELECT DISTINCT HarvestYear FROM v),
    (SELECT DISTINCT ID2 FROM v WHERE HarvestYear = 1) EXCEPT SELECT HarvestYear, ID2 FROM v)
SELECT HarvestYear, ID2, {r("GrainMassWet")} AS GrainMassWet, x AS CropExists,
  CAST(NULL AS DOUBLE) AS Longitude, CAST(NULL AS DOUBLE) AS Latitude
FROM v LEFT JOIN e ON y = HarvestYear AND u = ID2
UNION ALL SELECT HarvestYear, ID2, NULL, 0, {r("s_acctbal")}, {r("s_nationkey * 1.5")}
FROM gaps JOIN supplier ON s_suppkey = ID2""")
def publish_raw_table(spark, sf_dir):
    """Samples with their crop-present code, completed to the grid of the first day."""
    events = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    seen = (
        events.groupBy(day.alias("HarvestYear"), F.col("user_id").alias("ID2"))
        .agg(F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("GrainMassWet"))
    )
    present = (
        events.where(F.col("event_type") == "click")
        .select(day.alias("HarvestYear"), F.col("user_id").alias("ID2"), F.lit(1).alias("CropExists"))
        .distinct()
    )
    points = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ID2"),
        F.col("s_acctbal").alias("X"),
        (F.col("s_nationkey") * 1.5).alias("Y"),
    )
    raw = raw_table(seen, present, points, base_year=1)
    return rounded(
        raw.select("HarvestYear", "ID2", "GrainMassWet", "CropExists", "Longitude", "Latitude")
    )


@query(f"""WITH {S}, m AS (SELECT Crop, HarvestYear, {r("avg(GrainMassWet)")} AS GrainMassWet_mean
  FROM s GROUP BY Crop, HarvestYear) SELECT * FROM m
ORDER BY Crop NULLS LAST, HarvestYear NULLS LAST LIMIT 10""")
def first_means(spark, sf_dir):
    """The head of the sorted means, as shown to a reviewer."""
    means = means_by(samples(spark, sf_dir), ["Crop", "HarvestYear"], ["GrainMassWet"])
    return rounded(first_rows(means, ["Crop", "HarvestYear"], 10, nulls="last"))



@query(f"""WITH {S}, m AS (SELECT Crop, HarvestYear, {r("avg(GrainMassWet)")} AS GrainMassWet_mean
  FROM s GROUP BY Crop, HarvestYear) SELECT * FROM m
ORDER BY Crop NULLS FIRST, HarvestYear NULLS FIRST LIMIT 10""")
def first_means_nulls_first(spark, sf_dir):
    """The same head with unknown crops first."""
    means = means_by(samples(spark, sf_dir), ["Crop", "HarvestYear"], ["GrainMassWet"])
    return rounded(first_rows(means, ["Crop", "HarvestYear"], 10, nulls="first"))
