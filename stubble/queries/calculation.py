"""Calculated measures, area allocation, masks and validation of the split."""

from __future__ import annotations

from pyspark.sql import functions as F

from stubble.functions.measures import (
    allocate_area,
    keep_part,
    keep_total,
    residue_set,
)
from stubble.operators.calculate import CALCULATED, Regime, calculate
from stubble.operators.checks import split_counts
from stubble.operators.columns import condense
from stubble.plans.harvests import HARVEST_2015, harmonise
from stubble.queries.base import CALC, S, query, r, raw_samples, rounded, samples

ALL_BY_MODE = [Regime("by_mode", 1990, 2010)]
FOUR_BANDS = [
    Regime("by_mode", 1995, 1996),
    Regime("subsample", 1997, 1997),
    Regime("wet_only", 1998, 1999),
    Regime("air_dry_only", 2000, 2001),
]
_OUT = ", ".join(f"{r(c)} AS {c}" for c in CALCULATED)


def calculated(spark, sf_dir):
    """The sample view with every calculated measure, all years by sampling mode."""
    return calculate(raw_samples(spark, sf_dir), ALL_BY_MODE)


@query(f"WITH {CALC} SELECT HarvestYear, ID2, Crop, mode AS SamplingMode, {_OUT} FROM c")
def calc_yield_by_mode(spark, sf_dir):
    df = calculated(spark, sf_dir)
    return rounded(df.select("HarvestYear", "ID2", "Crop", "SamplingMode", *CALCULATED))


_BANDS = f"""WITH {S}, k AS (
  SELECT *, CASE WHEN HarvestYear BETWEEN 1995 AND 1996 THEN 1 WHEN HarvestYear = 1997 THEN 2
      WHEN HarvestYear BETWEEN 1998 AND 1999 THEN 3
      WHEN HarvestYear BETWEEN 2000 AND 2001 THEN 4 END AS band,
    coalesce(GrainSampleArea, 0) > 0 AS hg, coalesce(BiomassSampleArea, 0) > 0 AS hb
  FROM s), g AS (
  SELECT *, CASE WHEN band = 1 AND hb AND NOT hg THEN GrainMassWetInBiomassSample
      ELSE GrainMassWet END AS w,
    CASE WHEN band = 1 AND hb AND NOT hg THEN GrainMassAirDryInBiomassSample
      ELSE GrainMassAirDry END AS a,
    CASE WHEN hg AND hb THEN CASE WHEN band = 1 THEN GrainSampleArea + BiomassSampleArea END
      WHEN hg THEN GrainSampleArea WHEN hb THEN BiomassSampleArea END AS ar,
    CASE WHEN ResidueMassWetSubsample > 0 AND (band = 2 OR (band = 1 AND hb))
      THEN (ResidueMassWetSubsample - ResidueMassAirDrySubsample) / ResidueMassWetSubsample
      END AS rm
  FROM k WHERE band IS NOT NULL), h AS (
  SELECT *, CASE WHEN band = 1 THEN CASE WHEN hb AND BiomassWet > 0
        THEN BiomassWet - GrainMassWetInBiomassSample END
      WHEN band IN (2, 3) THEN BiomassWet - w END AS rw FROM g), z AS (
  SELECT *, CASE WHEN band IN (1, 2) THEN rw - rw * rm
      WHEN band = 4 THEN BiomassAirDry - a END AS rd FROM h)
SELECT HarvestYear, ID2, Crop,
  CASE band WHEN 1 THEN 'by_mode' WHEN 2 THEN 'subsample' WHEN 3 THEN 'wet_only'
    ELSE 'air_dry_only' END AS Regime,
  {r("CASE WHEN band <> 4 THEN w / nullif(ar, 0) END")} AS GrainYieldWet_P2,
  {r("CASE WHEN band <> 3 THEN a / nullif(ar, 0) END")} AS GrainYieldAirDry_P2,
  {r("CASE WHEN (band = 2 OR (band = 1 AND (hg OR hb))) AND w > 0 THEN (w - a) / w END")}
    AS GrainMoistureProportionPartial_P2,
  {r("rw")} AS ResidueMassWet_P2, {r("rd")} AS ResidueMassAirDry_P2,
  {r("CASE WHEN BiomassSampleArea > 0 THEN rw / BiomassSampleArea END")}
    AS ResidueMassWetPerArea_P2,
  {r("CASE WHEN BiomassSampleArea > 0 THEN rd / BiomassSampleArea END")}
    AS ResidueMassAirDryPerArea_P2
FROM z"""


@query(_BANDS)
def calc_by_regime(spark, sf_dir):
    df = calculate(raw_samples(spark, sf_dir), FOUR_BANDS)
    return rounded(
        df.select(
            "HarvestYear",
            "ID2",
            "Crop",
            "Regime",
            "GrainYieldWet_P2",
            "GrainYieldAirDry_P2",
            "GrainMoistureProportionPartial_P2",
            "ResidueMassWet_P2",
            "ResidueMassAirDry_P2",
            "ResidueMassWetPerArea_P2",
            "ResidueMassAirDryPerArea_P2",
        )
    )


@query(f"""WITH {S} SELECT count(*) AS rows_total,
  count(CASE WHEN HarvestYear NOT BETWEEN 1996 AND 1999 THEN 1 END) AS rows_outside_windows,
  count(CASE WHEN HarvestYear = 1996 AND (GrainSampleArea < 0 OR BiomassSampleArea < 0) THEN 1 END)
    AS rows_without_mode,
  count(CASE WHEN HarvestYear BETWEEN 1996 AND 1999 AND NOT (HarvestYear = 1996 AND
    (coalesce(GrainSampleArea, 0) < 0 OR coalesce(BiomassSampleArea, 0) < 0)) THEN 1 END)
    AS rows_kept FROM s""")
def row_conservation(spark, sf_dir):
    windows = [Regime("by_mode", 1996, 1996), Regime("wet_only", 1997, 1999)]
    return split_counts(
        samples(spark, sf_dir),
        windows,
        grain_area="GrainSampleArea",
        biomass_area="BiomassSampleArea",
    )


@query(f"""WITH {S} SELECT HarvestYear, ID2,
  CASE WHEN BiomassWet IS NULL AND GrainMassWet IS NULL THEN NULL
    WHEN BiomassWet IS NULL THEN CASE WHEN Crop = '1-URGENT' THEN 2.0
      WHEN Crop <> '1-URGENT' THEN 2.4384 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS GrainArea,
  CASE WHEN BiomassWet IS NULL AND GrainMassWet IS NULL THEN NULL
    WHEN BiomassWet IS NOT NULL THEN CASE WHEN Crop = '1-URGENT' THEN 2.0
      WHEN Crop <> '1-URGENT' THEN 2.4384 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS BiomassArea,
  CASE WHEN GrainSampleArea > 0 AND BiomassSampleArea > 0 THEN {r("GrainMassWet")} END AS TotalKept,
  CASE WHEN GrainSampleArea > 0 AND BiomassSampleArea > 0 THEN NULL
    ELSE {r("GrainMassWetInBiomassSample")} END AS PartKept
FROM s""")
def area_allocation(spark, sf_dir):
    crop = F.col("Crop")
    area = F.when(crop == "1-URGENT", 2.0).when(crop != "1-URGENT", 2.4384).otherwise(0.0)
    grain_area, biomass_area = allocate_area("BiomassWet", "GrainMassWet", area)
    areas = ("GrainSampleArea", "BiomassSampleArea")
    return rounded(
        samples(spark, sf_dir).select(
            "HarvestYear",
            "ID2",
            grain_area.cast("double").alias("GrainArea"),
            biomass_area.cast("double").alias("BiomassArea"),
            keep_total("GrainMassWet", *areas).alias("TotalKept"),
            keep_part("GrainMassWetInBiomassSample", *areas).alias("PartKept"),
        )
    )


_W = "(BiomassWet - GrainMassWetInBiomassSample)"
_M = (
    "((ResidueMassWetSubsample - ResidueMassAirDrySubsample) / nullif(ResidueMassWetSubsample, 0))"
)


@query(f"""WITH {S} SELECT ID2, {r(_W)} AS ResidueMassWet, {r(_M)} AS ResidueMoistureProportion,
  {r(f"{_W} * (1 - {_M})")} AS ResidueMassDry,
  {r(f"{_W} * (1 - {_M}) / nullif(BiomassSampleArea, 0)")} AS ResidueMassDryPerArea FROM s""")
def residue_in_one_go(spark, sf_dir):
    parts = residue_set(
        "BiomassWet",
        "GrainMassWetInBiomassSample",
        "ResidueMassWetSubsample",
        "ResidueMassAirDrySubsample",
        "BiomassSampleArea",
    )
    return rounded(
        samples(spark, sf_dir).select("ID2", *[e.alias(n) for n, e in parts.items()])
    )


@query(f"""WITH {S} SELECT HarvestYear, ID2, {r("GrainMassWet")} AS GrainMassWet_P1,
  {r("CASE WHEN BiomassWet > 100000 THEN BiomassWet END")} AS GrainMassWet_P2,
  {r("ResidueMassWetSubsample")} AS GrainMassWet_P3,
  {r("coalesce(ResidueMassWetSubsample, CASE WHEN BiomassWet > 100000 THEN BiomassWet END, GrainMassWet)")}
    AS GrainMassWet,
  {r("GrainMassAirDry")} AS Dry_P1, {r("ResidueMassAirDrySubsample")} AS Dry_P3,
  {r("coalesce(ResidueMassAirDrySubsample, GrainMassAirDry)")} AS Dry FROM s""")
def condense_levels(spark, sf_dir):
    levelled = samples(spark, sf_dir).select(
        "HarvestYear",
        "ID2",
        F.col("GrainMassWet").alias("GrainMassWet_P1"),
        F.when(F.col("BiomassWet") > 100000, F.col("BiomassWet")).alias("GrainMassWet_P2"),
        F.col("ResidueMassWetSubsample").alias("GrainMassWet_P3"),
        F.col("GrainMassAirDry").alias("Dry_P1"),
        F.col("ResidueMassAirDrySubsample").alias("Dry_P3"),
    )
    return rounded(condense(levelled, 3))


@query(f"""WITH {S}, f AS (SELECT *, CASE WHEN ID2 = 258 THEN 'SC' ELSE Crop END AS c FROM s)
SELECT HarvestYear, ID2, CAST(ID2 AS VARCHAR) AS SampleID, c AS Crop,
  CASE WHEN BiomassAirDry IS NULL AND GrainMassAirDry IS NULL THEN NULL
    WHEN BiomassAirDry IS NOT NULL THEN 0.0 WHEN c = 'SC' THEN 2.0 WHEN c <> 'SC' THEN 2.4384
    ELSE 0.0 END::DOUBLE AS GrainSampleArea,
  {r("GrainMassAirDry")} AS GrainMassAirDry,
  CASE WHEN BiomassAirDry IS NULL AND GrainMassAirDry IS NULL THEN NULL
    WHEN BiomassAirDry IS NULL THEN 0.0 WHEN c = 'SC' THEN 2.0 WHEN c <> 'SC' THEN 2.4384
    ELSE 0.0 END::DOUBLE AS BiomassSampleArea,
  {r("BiomassAirDry")} AS BiomassAirDry FROM f""")
def harmonise_sheet(spark, sf_dir):
    sheet = samples(spark, sf_dir).select(
        "HarvestYear",
        "ID2",
        "Crop",
        F.col("ID2").cast("string").alias("Barcode"),
        F.col("GrainMassAirDry").alias("GrainNetWt (g)"),
        F.col("BiomassAirDry").alias("NetWt (g)"),
    )
    return rounded(harmonise(sheet, HARVEST_2015))


