"""Gap-fill by moisture, tiered means and grouped regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from stubble.operators.gapfill import (
    fill_dry_from_moisture,
    fill_residue_by_regression,
    fill_residue_dry,
    fill_yield,
    residue_fill_stats,
)
from stubble.operators.staging import staged
from stubble.operators.stats import linear_fit, long_to_wide
from stubble.queries.base import CALC, S, query, r, rounded, samples, table, values
from stubble.queries.calculation import calculated

# Wet and dry yields with gaps: dry values above a limit are taken away.
_GAPS = f"""{CALC}, q AS (SELECT HarvestYear, ID2, Crop, GrainYieldWet_P2 AS gw,
  CASE WHEN GrainYieldAirDry_P2 <= 1700 THEN GrainYieldAirDry_P2 END AS gd,
  ResidueMassWetPerArea_P2 AS rw,
  CASE WHEN ResidueMassAirDryPerArea_P2 <= 1500 THEN ResidueMassAirDryPerArea_P2 END AS rd FROM c)"""


def with_gaps(spark, sf_dir):
    """Staged: the means and the fill both read it."""
    g, res = F.col("GrainYieldAirDry_P2"), F.col("ResidueMassAirDryPerArea_P2")
    gaps = calculated(spark, sf_dir).select(
        "HarvestYear",
        "ID2",
        "Crop",
        "GrainYieldWet_P2",
        F.when(g <= 1700, g).alias("GrainYieldAirDry_P2"),
        "ResidueMassWetPerArea_P2",
        F.when(res <= 1500, res).alias("ResidueMassAirDryPerArea_P2"),
    )
    return staged(gaps)


@query(f"""WITH {_GAPS}, means AS (SELECT Crop AS mc,
    avg(CASE WHEN rw > 0 AND rd > 0 THEN (rw - rd) / rw END) AS rm,
    avg(CASE WHEN gw > 0 AND gd > 0 THEN (gw - gd) / gw END) AS gm FROM q GROUP BY Crop)
SELECT HarvestYear, ID2, Crop, {r("gw")} AS GrainYieldWet_P2, {r("gd")} AS GrainYieldAirDry_P2,
  {r("rw")} AS ResidueMassWetPerArea_P2, {r("rd")} AS ResidueMassAirDryPerArea_P2,
  {r("rm")} AS ResidueMoistureProportionMeanCrop_P3,
  {r("gm")} AS GrainMoistureProportionMeanCrop_P3,
  {r("CASE WHEN rd IS NULL THEN rw - rw * rm END")} AS ResidueMassAirDryPerArea_P3,
  {r("CASE WHEN gd IS NULL THEN gw - gw * gm END")} AS GrainYieldAirDry_P3
FROM q LEFT JOIN means ON mc = Crop""")
def moisture_gapfill(spark, sf_dir):
    return rounded(fill_dry_from_moisture(with_gaps(spark, sf_dir)))


_MO = "(ResidueMassWetSubsample - ResidueMassAirDrySubsample) / nullif(ResidueMassWetSubsample, 0)"


@query(f"""WITH {S}, b AS (SELECT ID2, Crop, BiomassWet AS w,
    CASE WHEN BiomassAirDry <= 60000 THEN BiomassAirDry END AS d, BiomassSampleArea AS ar,
    {_MO} AS m FROM s), g AS (SELECT Crop AS gc, avg(m) AS mean FROM b GROUP BY Crop)
SELECT ID2, Crop, {r("mean")} AS AvgResidueMoistureProportionByCrop,
  {r("coalesce(d, w * (1 - mean))")} AS ResidueMassDry_P2,
  {r("coalesce(d / nullif(ar, 0), coalesce(d, w * (1 - mean)) / nullif(ar, 0))")}
    AS ResidueMassDryPerArea_P2
FROM b JOIN g ON gc IS NOT DISTINCT FROM Crop""")
def residue_dry_gapfill(spark, sf_dir):
    wet, dry = F.col("ResidueMassWetSubsample"), F.col("ResidueMassAirDrySubsample")
    d = F.when(F.col("BiomassAirDry") <= 60000, F.col("BiomassAirDry"))
    df = samples(spark, sf_dir).select(
        "ID2",
        "Crop",
        F.col("BiomassWet").alias("ResidueMassWet"),
        d.alias("ResidueMassDry"),
        F.col("BiomassSampleArea").alias("ResidueSampleArea"),
        F.try_divide(d, "BiomassSampleArea").alias("ResidueMassDryPerArea"),
        F.try_divide(wet - dry, wet).alias("ResidueMoistureProportion"),
    )
    return rounded(
        fill_residue_dry(staged(df)).select(
            "ID2",
            "Crop",
            "AvgResidueMoistureProportionByCrop",
            "ResidueMassDry_P2",
            "ResidueMassDryPerArea_P2",
        )
    )


@query(f"""WITH {S}, b AS (SELECT Crop,  {_MO} AS m FROM s)
SELECT Crop, {r("avg(m)")} AS AvgResidueMoistureProportionByCrop,
  {r("stddev_samp(m)")} AS SDResidueMoistureProportionByCrop,
  {r("stddev_samp(m) / sqrt(count(*))")} AS SEResidueMoistureProportionByCrop,
  count(*) AS n_samples FROM b WHERE m IS NOT NULL GROUP BY Crop""")
def residue_stats_by_crop(spark, sf_dir):
    wet, dry = F.col("ResidueMassWetSubsample"), F.col("ResidueMassAirDrySubsample")
    df = samples(spark, sf_dir).withColumn(
        "ResidueMoistureProportion", F.try_divide(wet - dry, wet)
    )
    return rounded(residue_fill_stats(df))


# Year 1996 has no yield at all, so its crops fall back to the mean of all years.
_YIELD = f"""{CALC}, y AS (SELECT HarvestYear, ID2, Crop, o_custkey AS Point,
    CASE WHEN HarvestYear <> 1996 THEN GrainYieldAirDry_P2 END AS v,
    CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS present
  FROM c JOIN orders ON o_orderkey = ID2), z AS (
  SELECT y.*, s_acctbal / 10000.0 AS rel, coalesce(avg(v) OVER (PARTITION BY HarvestYear, Crop),
    avg(v) OVER (PARTITION BY Crop)) AS mean FROM y LEFT JOIN supplier ON s_suppkey = Point), f AS (
  SELECT *, CASE WHEN v IS NULL AND present = 1 THEN mean * rel ELSE v END AS filled FROM z)"""


@query(f"""WITH {_YIELD} SELECT HarvestYear, ID2, Crop, {r("v")} AS GrainYieldDryPerArea,
  {r("mean")} AS GrainYieldDryPerAreaAvg, {r("filled")} AS GrainYieldDryPerArea_P3,
  CASE WHEN v IS NOT NULL THEN 2 WHEN filled IS NOT NULL THEN 3 END AS GrainYieldDryPerArea_P
FROM f""")
def tiered_mean_gapfill(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID2"),
        F.col("o_custkey").alias("Point"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("CropExists"),
    )
    value = F.when(F.col("HarvestYear") != 1996, F.col("GrainYieldAirDry_P2"))
    df = (
        calculated(spark, sf_dir)
        .select("HarvestYear", "ID2", "Crop", value.alias("GrainYieldDryPerArea"))
        .join(orders, "ID2")
    )
    relative = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("Point"), (F.col("s_acctbal") / 10000.0).alias("RelativeYield")
    )
    filled = fill_yield(staged(df), relative, point="Point")
    return rounded(
        filled.select(
            "HarvestYear",
            "ID2",
            "Crop",
            "GrainYieldDryPerArea",
            "GrainYieldDryPerAreaAvg",
            "GrainYieldDryPerArea_P3",
            "GrainYieldDryPerArea_P",
        )
    )


_PAIRS = f"""{CALC}, p AS (SELECT HarvestYear, ID2, Crop, GrainYieldAirDry_P2 AS x,
  CASE WHEN ResidueMassAirDryPerArea_P2 <= 1800 THEN ResidueMassAirDryPerArea_P2 END AS y FROM c)"""
_SPREAD = "count(*) > 1 AND max(x) > min(x)"
_FITS = f"""fits AS (SELECT HarvestYear AS fy, Crop AS fc, count(*) AS n,
    CASE WHEN {_SPREAD} THEN regr_slope(y, x) END AS b1,
    CASE WHEN {_SPREAD} THEN regr_intercept(y, x) ELSE avg(y) END AS b0,
    CASE WHEN {_SPREAD} THEN regr_r2(y, x) END AS r2
  FROM p WHERE x IS NOT NULL AND y IS NOT NULL AND Crop IS NOT NULL AND Crop <> '5-LOW'
  GROUP BY HarvestYear, Crop)"""
HI_BOUNDS = [
    ("1-URGENT", 0.35, 0.6),
    ("2-HIGH", 0.4, 0.55),
    ("3-MEDIUM", 0.3, 0.7),
]


def pairs(spark, sf_dir):
    res = F.col("ResidueMassAirDryPerArea_P2")
    return calculated(spark, sf_dir).select(
        "HarvestYear",
        "ID2",
        "Crop",
        F.col("GrainYieldAirDry_P2").alias("GrainYieldDryPerArea_P3"),
        F.when(res <= 1800, res).alias("ResidueMassDryPerArea_P2"),
    )


@query(f"""WITH {_PAIRS}, {_FITS} SELECT fy AS HarvestYear, fc AS Crop, {r("b0")} AS InterceptEstimate,
  {r("b1")} AS XEstimate,
  {r("CASE WHEN b1 IS NULL THEN 0.0 WHEN n > 2 THEN 1 - (1 - r2) * (n - 1) / (n - 2) END")}
    AS AdjRSquared, CASE WHEN b1 IS NULL THEN n - 1 ELSE n - 2 END AS DfResidual FROM fits""")
def group_regression(spark, sf_dir):
    df = pairs(spark, sf_dir)
    usable = df.where(F.col("Crop").isNotNull() & (F.col("Crop") != "5-LOW"))
    return rounded(
        linear_fit(
            usable, ["HarvestYear", "Crop"], "GrainYieldDryPerArea_P3", "ResidueMassDryPerArea_P2"
        )
    )


@query(f"""WITH {_PAIRS}, {_FITS}, hb AS (SELECT * FROM {values(HI_BOUNDS, "t(hc, lo, hi)")}),
  h AS (SELECT *, CASE WHEN x + y <> 0 THEN x / (x + y) END AS idx FROM p),
  hm AS (SELECT *, coalesce(avg(idx) OVER (PARTITION BY HarvestYear, Crop),
      avg(idx) OVER (PARTITION BY Crop)) AS himean FROM h),
  l AS (SELECT *, CASE WHEN y IS NULL THEN b0 + b1 * x END AS lin FROM hm
    LEFT JOIN fits ON fy = HarvestYear AND fc = Crop LEFT JOIN hb ON hc = Crop),
  e AS (SELECT *, CASE WHEN x + lin <> 0 THEN x / (x + lin) END AS li FROM l),
  o AS (SELECT *, CASE WHEN li < lo OR li > hi OR (li IS NULL AND y IS NULL)
    THEN x / nullif(himean, 0) - x END AS byhi FROM e)
SELECT HarvestYear, ID2, Crop, {r("x")} AS GrainYieldDryPerArea_P3,
  {r("y")} AS ResidueMassDryPerArea_P2, {r("himean")} AS HarvestIndexAvg,
  {r("coalesce(y, byhi, lin)")} AS ResidueMassDryPerArea_P3,
  CASE WHEN y IS NOT NULL THEN 2 WHEN coalesce(byhi, lin) IS NOT NULL THEN 3 END
    AS ResidueMassDryPerArea_P FROM o""")
def regression_gapfill(spark, sf_dir):
    bounds = spark.createDataFrame(HI_BOUNDS, "Crop string, HIMin double, HIMax double")
    filled = fill_residue_by_regression(
        staged(pairs(spark, sf_dir)), bounds, left_out=("5-LOW",)
    )
    return rounded(
        filled.select(
            "HarvestYear",
            "ID2",
            "Crop",
            "GrainYieldDryPerArea_P3",
            "ResidueMassDryPerArea_P2",
            "HarvestIndexAvg",
            "ResidueMassDryPerArea_P3",
            "ResidueMassDryPerArea_P",
        )
    )


@query("""SELECT l_linestatus AS status, {a} AS A, {n} AS N, {x} AS R FROM lineitem
GROUP BY l_linestatus""".format(
    **{
        k: r(f"avg(CASE WHEN l_returnflag = '{f}' THEN l_quantity END)")
        for k, f in (("a", "A"), ("n", "N"), ("x", "R"))
    }
))
def terms_side_by_side(spark, sf_dir):
    long = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("term"))
        .agg(F.avg("l_quantity").alias("estimate"))
    )
    return rounded(long_to_wide(long, ["status"], "term", "estimate", ["A", "N", "R"]))
