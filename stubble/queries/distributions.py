"""Distributions per group, and the level whose outliers are found from the data."""

from __future__ import annotations

import statistics

from pyspark.sql import functions as F

from stubble.operators.distribution import density, plotting_positions, qq_points
from stubble.operators.fences import outliers_removed
from stubble.operators.qc import init_audit
from stubble.queries.base import query, r, rounded, values
from stubble.queries.summaries import _FENCED, _quantile, BY, tailed

_POINTS = 64
_Z = [(p, statistics.NormalDist().inv_cdf(p)) for p in plotting_positions()]
_SAMPLES = ", ".join(f"{_quantile(p, 'v')} AS s{i}" for i, (p, _) in enumerate(_Z))
_WHICH = " ".join(f"WHEN {p!r} THEN s{i}" for i, (p, _) in enumerate(_Z))


@query(f"""WITH {_FENCED}, d1 AS (SELECT HarvestYear, Crop, avg(v) AS mean, stddev_samp(v) AS sd, {_SAMPLES}
  FROM v WHERE v IS NOT NULL GROUP BY HarvestYear, Crop)
SELECT HarvestYear, Crop, {r("p")} AS probability, {r("z")} AS theoretical, {r("mean + z * sd")} AS fitted,
  {r(f"CASE p {_WHICH} END")} AS sample FROM d1, {values(_Z, "z(p, z)")}""")
def qq_per_group(spark, sf_dir):
    """Plotting positions per year and crop: exact quantiles beside normal ones."""
    return rounded(qq_points(tailed(spark, sf_dir), BY, "v"))


@query(f"""WITH {_FENCED}, d1 AS (SELECT HarvestYear, Crop, count(v) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi,
    {_quantile(0.25, 'v')} AS g1, {_quantile(0.75, 'v')} AS g3 FROM v WHERE v IS NOT NULL GROUP BY HarvestYear, Crop),
  d2 AS (SELECT *, 0.9::DOUBLE * coalesce(nullif(least(sd, (g3 - g1) / 1.34::DOUBLE), 0), nullif(sd, 0), nullif(abs(lo), 0), 1)
    * pow(n, -0.2::DOUBLE) AS bw FROM d1 WHERE n > 1),
  x AS (SELECT *, lo - 3 * bw AS f0, (hi - lo + 6 * bw) / {_POINTS - 1} AS step FROM d2),
  b AS (SELECT x.HarvestYear, x.Crop, (v.v - f0) / step AS place, least(floor((v.v - f0) / step), {_POINTS - 2}) AS i
    FROM v JOIN x ON v.HarvestYear = x.HarvestYear AND v.Crop IS NOT DISTINCT FROM x.Crop WHERE v.v IS NOT NULL),
  d3 AS (SELECT HarvestYear, Crop, i, sum(share) AS share FROM (
    SELECT HarvestYear, Crop, i, 1 - (place - i) AS share FROM b
    UNION ALL SELECT HarvestYear, Crop, i + 1, place - i FROM b) GROUP BY HarvestYear, Crop, i)
SELECT x.HarvestYear, x.Crop, {r("any_value(f0 + t * step)")} AS at,
  {r(f"sum(share * exp(-((t - i) * step / bw) * ((t - i) * step / bw) / 2) / sqrt(2 * pi())) / any_value(n * bw) * 10000")}
    AS density
FROM x JOIN d3 ON d3.HarvestYear = x.HarvestYear AND d3.Crop IS NOT DISTINCT FROM x.Crop, range({_POINTS}) AS t(t)
GROUP BY x.HarvestYear, x.Crop, t""")
def density_per_group(spark, sf_dir):
    """A kernel density per year and crop, in ten thousandths."""
    found = density(tailed(spark, sf_dir), BY, "v", _POINTS)
    return rounded(found.withColumn("density", F.col("density") * 10000))


_OUT = "v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)"


@query(f"""WITH {_FENCED} SELECT HarvestYear, ID2, Crop, {r(f"CASE WHEN NOT ({_OUT}) THEN v END")} AS V_P2,
  CASE WHEN q1 IS NULL THEN '000001' ELSE '001001' END AS V_P2_qcApplied,
  CASE WHEN {_OUT} THEN '001000' ELSE '000000' END AS V_P2_qcResult, coalesce({_OUT}, false) AS told FROM f""")
def level_four(spark, sf_dir):
    """The calculated level without outliers: fences from the data, audited by a bit of their own."""
    level = init_audit(tailed(spark, sf_dir).withColumnRenamed("v", "V_P2"), ["HarvestYear", "ID2", "Crop"])
    removed, _ = outliers_removed(level, BY, ["V_P2"])
    told = F.col("V_P2_qcPhrase").contains("(Outlier) Value V_P2 is outside") & F.col("V_P2_qcPhrase").contains("Previous val")
    return rounded(removed.withColumn("told", F.coalesce(told, F.lit(False))).drop("V_P2_qcPhrase"))
