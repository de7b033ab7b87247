"""Review jobs: compare sources, summarise levels, choose reconciled values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stubble.functions import as_col
from stubble.functions.measures import mean_of_present, positive
from stubble.operators.joins import attach
from stubble.operators.outliers import remove_extremes
from stubble.operators.sets import merge_surveys
from stubble.operators.stats import era_means, means_by

# Year bands with one sampling method each.
ERAS = [(1999, 2010), (2011, 2012), (2013, 2016), (2017, 2022)]


def reconciled(
    df: DataFrame,
    reanalysed: DataFrame,
    join_keys: list[str],
    group: list[str],
    measures: dict[str, tuple[str, str]],
) -> DataFrame:
    """Two sources of one measure: zeros and extremes removed, then the mean of both.

    ``measures`` maps a result to its (own, re-analysed) columns. Every step is kept as
    a column for review: ``A``/``B`` the scrubbed sources, ``Final`` the result.
    """
    both = attach(df, reanalysed, join_keys)
    scrubbed = both.withColumns(
        {
            f"{m}{side}": positive(c)
            for m, pair in measures.items()
            for side, c in zip("AB", pair)
        }
    )
    cut = {f"{m}{side}Kept": as_col(f"{m}{side}") for m in measures for side in "AB"}
    fenced = remove_extremes(scrubbed.withColumns(cut), group, list(cut))
    return fenced.withColumns(
        {f"{m}Final": mean_of_present(f"{m}AKept", f"{m}BKept") for m in measures}
    )


def yearly_means(df: DataFrame, drop: list[str] = ("Longitude", "Latitude", "SampleID", "Comments")) -> DataFrame:
    """Mean of every numeric measure per year and crop."""
    numeric = df.drop(*drop)
    columns = [
        f.name
        for f in numeric.schema.fields
        if f.name not in ("HarvestYear", "Crop", "ID2")
        and f.dataType.typeName() in ("double", "float", "integer", "long")
    ]
    return means_by(numeric, ["HarvestYear", "Crop"], columns)


def with_later_survey(clean: DataFrame, later: DataFrame, site: str) -> DataFrame:
    """The clean level followed by a later survey of one site."""
    return merge_surveys(
        clean,
        later,
        "FieldId",
        site,
        {"ResidueDryPerArea": F.col("BiomassDryPerArea") - F.col("GrainYieldDryPerArea")},
        {
            "HarvestYear": "HarvestYear",
            "ID2": "ID2",
            "Crop": "Crop",
            "GrainYieldDryPerArea": "GrainYieldAirDry",
            "ResidueDryPerArea": "ResidueMassAirDryPerArea",
        },
    )


def method_comparison(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means per crop and method era."""
    return era_means(df, "HarvestYear", "Crop", columns, ERAS)
