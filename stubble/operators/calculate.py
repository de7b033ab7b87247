"""Calculated measures (level 2) from raw masses and areas.

Each year window has its own rules and, in the first window, each way of sampling too.
All of them are one projection: a row's regime and mode select a branch, so the table is
read once instead of being split and put together again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stubble.functions import as_col
from stubble.functions.measures import (
    dry_from_wet,
    guarded_ratio,
    moisture_share,
    residue_by_difference,
)
from stubble.functions.naming import audit_names
from stubble.operators.columns import project, with_audit_columns


@dataclass(frozen=True)
class Regime:
    """An inclusive window of years and the rule set that holds in it."""

    rules: str  # by_mode | subsample | wet_only | air_dry_only
    first: int
    last: int


# Year windows of the four rule sets.
REGIMES = [
    Regime("by_mode", 1999, 2009),
    Regime("subsample", 2010, 2010),
    Regime("wet_only", 2011, 2012),
    Regime("air_dry_only", 2013, 2016),
]

# Published order of raw and calculated columns.
ORDER = [
    "HarvestYear",
    "ID2",
    "Longitude",
    "Latitude",
    "SampleID",
    "Crop",
    "CropExists_P1",
    "GrainSampleArea_P1",
    "GrainMassWet_P1",
    "GrainMassWetInGrainSample_P1",
    "GrainMassWetInGrainSample_P2",
    "GrainMassAirDryInGrainSample_P1",
    "GrainMassAirDryInGrainSample_P2",
    "GrainMassAirDry_P1",
    "GrainMoistureProportionPartial_P2",
    "GrainMoisture_P1",
    "GrainProtein_P1",
    "GrainStarch_P1",
    "GrainWGlutDM_P1",
    "GrainOilDM_P1",
    "GrainTestWeight_P1",
    "GrainCarbon_P1",
    "GrainNitrogen_P1",
    "GrainSulfur_P1",
    "BiomassSampleArea_P1",
    "BiomassWet_P1",
    "BiomassAirDry_P1",
    "GrainMassWetInBiomassSample_P1",
    "GrainMassAirDryInBiomassSample_P1",
    "GrainMassAirDryInBiomassSample_P2",
    "ResidueMassWetSubsample_P1",
    "ResidueMassAirDrySubsample_P1",
    "ResidueMoistureProportionPartialSubsample_P2",
    "ResidueCarbon_P1",
    "ResidueNitrogen_P1",
    "ResidueSulfur_P1",
    "GrainYieldWet_P2",
    "GrainYieldAirDry_P2",
    "ResidueMassWet_P2",
    "ResidueMassAirDry_P2",
    "ResidueMassWetPerArea_P2",
    "ResidueMassAirDryPerArea_P2",
    "Comments",
]

CALCULATED = [c for c in ORDER if c.endswith("_P2")]


def in_years(year, regimes: list[Regime]) -> Column:
    """True for a year in one of the windows; null for a null year."""
    tests = [as_col(year).between(x.first, x.last) for x in regimes]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def regime_of(year, regimes: list[Regime] = REGIMES) -> Column:
    """Rule set of a year; null outside every window."""
    expr = F
    for x in regimes:
        expr = expr.when(as_col(year).between(x.first, x.last), F.lit(x.rules))
    return expr


def has_no_mode(grain_area, biomass_area) -> Column:
    """A negative area fits no sampling mode."""
    return (F.coalesce(as_col(grain_area), F.lit(0.0)) < 0) | (
        F.coalesce(as_col(biomass_area), F.lit(0.0)) < 0
    )


def sampling_mode(grain_area, biomass_area) -> Column:
    """grain, biomass, both or neither; null area counts as zero, negative as no mode."""
    g = F.coalesce(as_col(grain_area), F.lit(0.0))
    b = F.coalesce(as_col(biomass_area), F.lit(0.0))
    return (
        F.when((g > 0) & (b == 0), "grain")
        .when((g == 0) & (b > 0), "biomass")
        .when((g > 0) & (b > 0), "both")
        .when((g == 0) & (b == 0), "neither")
    )


def with_regime_and_mode(df: DataFrame, regimes: list[Regime] = REGIMES) -> DataFrame:
    return df.withColumns(
        {
            "Regime": regime_of("HarvestYear", regimes),
            "SamplingMode": sampling_mode("GrainSampleArea_P1", "BiomassSampleArea_P1"),
        }
    )


def calculate(df: DataFrame, regimes: list[Regime] = REGIMES) -> DataFrame:
    """All calculated columns; expects raw ``_P1`` columns.

    Rows outside every year window, and rows of the first rule set that fit no sampling
    mode, take no part; ``checks.split_counts`` reports how many.
    """
    grain_area, bio_area = F.col("GrainSampleArea_P1"), F.col("BiomassSampleArea_P1")
    early = [x for x in regimes if x.rules == "by_mode"]
    df = df.where(in_years("HarvestYear", regimes)).where(
        ~(in_years("HarvestYear", early) & has_no_mode(grain_area, bio_area))
    )
    df = with_regime_and_mode(df, regimes)
    regime, mode = F.col("Regime"), F.col("SamplingMode")
    by_mode = regime == "by_mode"

    # Conditions and areas shared by several measures are columns of their own: computed
    # once per row, and the generated code stays small enough to be compiled.
    early_both = by_mode & (mode == "both")
    steps = {
        "__both": early_both,
        "__residue": by_mode & mode.isin("biomass", "both"),
        "__moisture": (by_mode & (mode != "neither")) | (regime == "subsample"),
        "__area": F.when(mode == "grain", grain_area)
        .when(mode == "biomass", bio_area)
        .when(early_both, grain_area + bio_area),
        # Grain masses of an early single-sample row are those of the sample taken.
        "GrainMassWet_P1": _taken(by_mode, mode, "GrainMassWet", "GrainMassWet_P1"),
        "GrainMassAirDry_P1": _taken(by_mode, mode, "GrainMassAirDry", "GrainMassAirDry_P1"),
    }
    df = df.withColumns(steps)
    both, residue, moist = F.col("__both"), F.col("__residue"), F.col("__moisture")
    wet, dry, area = F.col("GrainMassWet_P1"), F.col("GrainMassAirDry_P1"), F.col("__area")
    in_biomass = F.col("GrainMassWetInBiomassSample_P1")
    df = df.withColumns(
        {
            "GrainYieldWet_P2": F.when(regime != "air_dry_only", wet / area),
            "GrainYieldAirDry_P2": F.when(regime != "wet_only", dry / area),
            "GrainMoistureProportionPartial_P2": F.when(moist, moisture_share(wet, dry)),
            "ResidueMoistureProportionPartialSubsample_P2": F.when(
                residue | (regime == "subsample"),
                moisture_share("ResidueMassWetSubsample_P1", "ResidueMassAirDrySubsample_P1"),
            ),
            "GrainMassWetInGrainSample_P2": F.when(both, residue_by_difference(wet, in_biomass)),
            "ResidueMassWet_P2": F.when(
                residue, residue_by_difference("BiomassWet_P1", in_biomass, guarded=True)
            ).when(
                regime.isin("subsample", "wet_only"), residue_by_difference("BiomassWet_P1", wet)
            ),
        }
    )
    grain_moisture = F.col("GrainMoistureProportionPartial_P2")
    df = df.withColumns(
        {
            "GrainMassAirDryInGrainSample_P2": dry_from_wet(
                "GrainMassWetInGrainSample_P2", grain_moisture
            ),
            "GrainMassAirDryInBiomassSample_P2": F.when(
                both, dry_from_wet(in_biomass, grain_moisture)
            ),
            "ResidueMassAirDry_P2": F.when(
                regime == "air_dry_only", residue_by_difference("BiomassAirDry_P1", dry)
            ).otherwise(
                dry_from_wet("ResidueMassWet_P2", "ResidueMoistureProportionPartialSubsample_P2")
            ),
        }
    )
    return df.withColumns(
        {
            "ResidueMassWetPerArea_P2": guarded_ratio("ResidueMassWet_P2", bio_area),
            "ResidueMassAirDryPerArea_P2": guarded_ratio("ResidueMassAirDry_P2", bio_area),
        }
    ).drop("__both", "__residue", "__moisture", "__area")


def _taken(by_mode: Column, mode: Column, measure: str, total: str) -> Column:
    return (
        F.when(by_mode & (mode == "grain"), as_col(f"{measure}InGrainSample_P1"))
        .when(by_mode & (mode == "biomass"), as_col(f"{measure}InBiomassSample_P1"))
        .otherwise(as_col(total))
    )


def ordered(df: DataFrame) -> DataFrame:
    """Published column order with audit triplets after the raw columns that have them."""
    wanted = with_audit_columns(ORDER, level=1)
    audited = {a for c in df.columns for a in audit_names(c)}
    return project(df, [c for c in wanted if c in df.columns or c not in audited])
