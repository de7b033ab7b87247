"""Group summaries, exact quantiles, outlier classes and binned counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stubble.operators.outliers import (
    add_outlier_class,
    add_quartile_class,
    map_layer,
    remove_extremes,
)
from stubble.operators.quantiles import quantiles_with_iqr
from stubble.operators.staging import staged
from stubble.operators.stats import (
    box_summary,
    era_means,
    histogram,
    mean_sd_se,
    means_by,
    normality_screen,
    side_by_side,
)
from stubble.queries.base import CALC, MEASURES, S, query, r, rounded, samples
from stubble.queries.calculation import calculated

BY = ["HarvestYear", "Crop"]
_MEANS = ", ".join(f"{r(f'avg({c})')} AS {c}_mean" for c in MEASURES)


@query(f"WITH {S} SELECT HarvestYear, Crop, {_MEANS} FROM s GROUP BY HarvestYear, Crop")
def mean_by_year_crop(spark, sf_dir):
    return rounded(means_by(samples(spark, sf_dir), BY, MEASURES))


@query(f"""WITH {CALC} SELECT Crop, CASE WHEN HarvestYear BETWEEN 1995 AND 1997 THEN '1995-1997'
    WHEN HarvestYear BETWEEN 1998 AND 1998 THEN '1998-1998' ELSE '1999-2000' END AS Era,
  {r("avg(GrainYieldWet_P2)")} AS GrainYieldWet_P2_mean,
  {r("avg(GrainYieldAirDry_P2)")} AS GrainYieldAirDry_P2_mean
FROM c WHERE HarvestYear BETWEEN 1995 AND 2000 GROUP BY 1, 2""")
def means_by_era(spark, sf_dir):
    return rounded(
        era_means(
            calculated(spark, sf_dir),
            "HarvestYear",
            "Crop",
            ["GrainYieldWet_P2", "GrainYieldAirDry_P2"],
            [(1995, 1997), (1998, 1998), (1999, 2000)],
        )
    )


@query(f"""WITH {CALC} SELECT Crop, {r("avg(GrainYieldWet_P2)")} AS mean,
  {r("stddev_samp(GrainYieldWet_P2)")} AS sd,
  {r("stddev_samp(GrainYieldWet_P2) / sqrt(count(*))")} AS se, count(*) AS n_samples
FROM c WHERE GrainYieldWet_P2 IS NOT NULL GROUP BY Crop""")
def group_mean_sd_se(spark, sf_dir):
    return rounded(mean_sd_se(calculated(spark, sf_dir), ["Crop"], "GrainYieldWet_P2"))


def _sides(suffix: str, c: str) -> str:
    return (
        f"{r(f'max({c})')} AS max{suffix}, {r(f'avg({c})')} AS mean{suffix}, "
        f"{r(f'stddev_samp({c}) / sqrt(count(*))')} AS se{suffix}, count({c}) AS n{suffix}"
    )


@query(
    f"WITH {CALC} SELECT HarvestYear, Crop, {_sides('Wet', 'GrainYieldWet_P2')}, "
    f"{_sides('Dry', 'ResidueMassAirDryPerArea_P2')} FROM c GROUP BY HarvestYear, Crop"
)
def two_sources_summary(spark, sf_dir):
    columns = {"Wet": "GrainYieldWet_P2", "Dry": "ResidueMassAirDryPerArea_P2"}
    return rounded(side_by_side(calculated(spark, sf_dir), BY, columns, with_max=True))


def _quantile(p: float, v: str = "GrainYieldWet_P2") -> str:
    return f"quantile_cont({v}, {p})"


@query(f"""WITH {CALC} SELECT HarvestYear, Crop, count(GrainYieldWet_P2) AS GrainYieldWet_P2_n,
  {r(_quantile(0.25))} AS GrainYieldWet_P2_q25, {r(_quantile(0.5))} AS GrainYieldWet_P2_q50,
  {r(_quantile(0.75))} AS GrainYieldWet_P2_q75,
  {r(f"{_quantile(0.75)} - {_quantile(0.25)}")} AS GrainYieldWet_P2_iqr
FROM c WHERE GrainYieldWet_P2 IS NOT NULL GROUP BY HarvestYear, Crop""")
def group_quantiles(spark, sf_dir):
    yields = staged(calculated(spark, sf_dir).select(*BY, "GrainYieldWet_P2"))
    return rounded(quantiles_with_iqr(yields, BY, "GrainYieldWet_P2"))


# Residue per area has a long tail when divided by small areas: real outliers.
_V = "ResidueMassWetPerArea_P2 * ResidueMassWetPerArea_P2 / GrainYieldWet_P2"
_FENCED = f"""{CALC}, v AS (SELECT HarvestYear, ID2, Crop, CASE WHEN GrainYieldWet_P2 > 0
    THEN {_V} END AS v FROM c),
  q AS (SELECT HarvestYear AS qy, Crop AS qc, {_quantile(0.25, 'v')} AS q1,
    {_quantile(0.5, 'v')} AS q2, {_quantile(0.75, 'v')} AS q3
    FROM v WHERE v IS NOT NULL GROUP BY HarvestYear, Crop),
  f AS (SELECT * FROM v LEFT JOIN q ON qy = HarvestYear AND qc IS NOT DISTINCT FROM Crop)"""
_OUTLIER = """CASE WHEN v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1) THEN 2
  WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END"""
_QUARTILE = "CASE WHEN v >= q3 THEN 4 WHEN v >= q2 THEN 3 WHEN v > q1 THEN 2 WHEN v <= q1 THEN 1 END"


def tailed(spark, sf_dir):
    """Staged: the quantile passes read these few columns instead of the join behind them."""
    wet, res = F.col("GrainYieldWet_P2"), F.col("ResidueMassWetPerArea_P2")
    return staged(
        calculated(spark, sf_dir).select(
            "HarvestYear", "ID2", "Crop", F.when(wet > 0, res * res / wet).alias("v")
        )
    )


@query(f"""WITH {_FENCED} SELECT HarvestYear, ID2, Crop,
  {r("CASE WHEN v >= q1 - 3 * (q3 - q1) AND v <= q3 + 3 * (q3 - q1) THEN v END")} AS v FROM f""")
def iqr_null_outliers(spark, sf_dir):
    return rounded(remove_extremes(tailed(spark, sf_dir), BY, ["v"]))


@query(f"WITH {_FENCED} SELECT HarvestYear, ID2, Crop, {r('v')} AS v, {_OUTLIER} AS Outliers FROM f")
def outlier_class(spark, sf_dir):
    return rounded(add_outlier_class(tailed(spark, sf_dir), BY, "v"))


@query(f"WITH {_FENCED} SELECT HarvestYear, ID2, Crop, {r('v')} AS v, {_QUARTILE} AS Quartiles FROM f")
def quartile_class(spark, sf_dir):
    return rounded(add_quartile_class(tailed(spark, sf_dir), BY, "v"))


@query(f"""WITH {_FENCED} SELECT HarvestYear, ID2, Crop, {r('v')} AS v, {_QUARTILE} AS Quartiles,
  {_OUTLIER} AS Outliers, CAST(ID2 AS VARCHAR) AS Label FROM f""")
def map_classes(spark, sf_dir):
    df = tailed(spark, sf_dir).withColumn("Point", F.col("ID2").cast("string"))
    return rounded(map_layer(df, "v", BY, ["ID2"], "Point"))


@query(f"""WITH {_FENCED} SELECT HarvestYear, Crop, count(*) AS n,
  min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN {r('v')} END) AS whisker_low, {r("any_value(q1)")} AS q1,
  {r("any_value(q2)")} AS median, {r("any_value(q3)")} AS q3,
  max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN {r('v')} END) AS whisker_high
FROM f WHERE v IS NOT NULL GROUP BY HarvestYear, Crop""")
def box_stats(spark, sf_dir):
    return rounded(box_summary(tailed(spark, sf_dir), BY, "v"))


@query(f"""WITH {S}, e AS (SELECT HarvestYear AS ey, Crop AS ec, min(GrainMassWet) AS lo,
    max(GrainMassWet) AS hi FROM s GROUP BY HarvestYear, Crop)
SELECT HarvestYear, Crop, CAST(CASE WHEN hi = lo THEN 1
  ELSE least(floor((GrainMassWet - lo) / (hi - lo) * 30) + 1, 30) END AS INT) AS bin, count(*) AS n
FROM s JOIN e ON ey = HarvestYear AND ec IS NOT DISTINCT FROM Crop
WHERE GrainMassWet IS NOT NULL GROUP BY 1, 2, 3""")
def histogram_bins(spark, sf_dir):
    return histogram(samples(spark, sf_dir), BY, "GrainMassWet", 30)


_Z = "(GrainMassWet - mu)"


@query(f"""WITH {S}, g AS (SELECT Crop AS gc, avg(GrainMassWet) AS mu FROM s GROUP BY Crop)
SELECT Crop, count(*) AS n,
  {r(f"avg(pow({_Z}, 3)) / pow(avg(pow({_Z}, 2)), 1.5)")} AS skewness,
  {r(f"avg(pow({_Z}, 4)) / pow(avg(pow({_Z}, 2)), 2) - 3")} AS kurtosis
FROM s JOIN g ON gc IS NOT DISTINCT FROM Crop WHERE GrainMassWet IS NOT NULL GROUP BY Crop""")
def normality(spark, sf_dir):
    return rounded(normality_screen(samples(spark, sf_dir), ["Crop"], "GrainMassWet"))
