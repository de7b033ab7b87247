"""Harmonise yearly lab sheets into one sample table.

Every year has its own sheets, column names, corrections and area rule. A year is a
``Harvest``: plain data saying what its columns are called and which fixes apply. The
steps themselves are the same for all years.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stubble.functions import as_col, quoted
from stubble.functions.measures import (
    allocate_area,
    date_of_serial,
    keep_part,
    keep_total,
    positive,
    prefer,
    residue_set,
    within,
    zero_to_null,
)
from stubble.functions.text import (
    append_notes,
    note_in,
    number_in,
    paste,
    remove_first,
    split_pieces,
)
from stubble.operators.checks import measure_mismatches
from stubble.operators.columns import recode, rename_by_pattern, try_cast_columns
from stubble.operators.grid import append_missing
from stubble.operators.joins import (
    attach,
    attach_points_full,
    correct,
    full_attach,
    merge_sides,
)
from stubble.operators.replicates import choose_replicates, first_non_null
from stubble.operators.sets import union_diagonal
from stubble.operators.staging import staged
from stubble.sources.tables import SAMPLE_COLUMNS

# Spelled-out crop names and their codes.
CROP_CODES = {
    "winter wheat": "WW",
    "spring wheat": "SW",
    "spring barley": "SB",
    "spring canola": "SC",
    "spring pea": "SP",
    "winter barley": "WB",
    "winter pea": "WP",
    "winter canola": "WC",
    "Winter Canola": "WC",
    "winter lentil": "WL",
    "Garbonzo Beans": "GB",
    "Alfalfa": "AL",
}

# Harvested areas in square metres.
PIPE_AREA = 2.0
ROW_AREA = 2.4384


@dataclass(frozen=True)
class Harvest:
    """How one year's joined sheet becomes sample rows."""

    renames: dict[str, str] = field(default_factory=dict)
    numbers: list[str] = field(default_factory=list)  # text cells read as numbers
    notes: list[tuple[str, str, str]] = field(default_factory=list)  # label, text cell, ending
    constants: dict[str, object] = field(default_factory=dict)
    corrections: list[tuple[str, list]] = field(default_factory=list)  # (column, cases)
    codes: dict[str, str] = field(default_factory=dict)
    biomass: str | None = None  # mass that decides the area
    grain: str | None = None
    area: str | float | None = None  # column, constant, or "by_crop"
    required: list[str] = field(default_factory=list)


def area_of(area: str | float) -> Column:
    """A constant area, a column, or the area of the crop's harvest method."""
    if area == "by_crop":
        crop = F.col("Crop")
        return F.when(crop == "SC", PIPE_AREA).when(crop != "SC", ROW_AREA).otherwise(0.0)
    return as_col(area) if isinstance(area, str) else F.lit(float(area))


def harmonise(df: DataFrame, harvest: Harvest) -> DataFrame:
    """Corrections, notes, names, areas, codes; then the sample columns present."""
    for column, cases in harvest.corrections:
        df = correct(df, column, cases)
    if harvest.notes:
        texts = [(label, note_in(c), end) for label, c, end in harvest.notes]
        df = df.withColumn("Comments", append_notes(*texts))
    df = df.withColumns({c: number_in(c) for c in harvest.numbers})
    df = df.withColumnsRenamed(harvest.renames)
    df = df.withColumns({c: F.lit(v) for c, v in harvest.constants.items()})
    if harvest.area is not None:
        grain_area, bio_area = allocate_area(harvest.biomass, harvest.grain, area_of(harvest.area))
        df = df.withColumns({"GrainSampleArea": grain_area, "BiomassSampleArea": bio_area})
    if harvest.codes:
        df = recode(df, harvest.codes)
    for c in harvest.required:
        df = df.where(as_col(c).isNotNull())
    return df.select(
        *[as_col(c).cast(t).alias(c) for c, t in SAMPLE_COLUMNS.items() if c in df.columns]
    )


def locate(df: DataFrame, points: DataFrame, row: str, column: str) -> DataFrame:
    """Attach reference points by grid row and column; unmatched points survive."""
    keyed = try_cast_columns(
        df.withColumnsRenamed({row: "Row2", column: "Column"}),
        {"Row2": "string", "Column": "int"},
    )
    return attach_points_full(keyed, points, ["Column", "Row2"])


def reanalysis(sheet: DataFrame) -> DataFrame:
    """One re-analysed grain sheet: crop-prefixed measure names made common, cells typed."""
    common = rename_by_pattern(
        sheet, {"%C": "GrainCarbon", "%N": "GrainNitrogen", "rotein": "GrainProtein"}
    ).withColumnsRenamed(
        {"COLUMN": "Column", "ROW2": "Row2", "Total grain weight (dry) (g)": "GrainMassDry"}
    )
    typed = try_cast_columns(
        common,
        {
            "Year": "int",
            "Column": "int",
            "Row2": "string",
            "GrainMassDry": "double",
            "GrainCarbon": "double",
            "GrainNitrogen": "double",
            "GrainProtein": "double",
        },
    )
    return typed.select(
        "Year", "Column", "Row2", "Crop", "GrainMassDry", "GrainCarbon", "GrainNitrogen", "GrainProtein"
    )


# ---- first window of years ---------------------------------------------------

# Column names of the legacy sheet.
N_LEGACY = "Grain Nitrogen %...19"
C_LEGACY = "Grain Carbon %...21"
GRAIN_AREA = "Non-Residue Grain Sample Area (square meters)"
RESIDUE_AREA = "Residue Sample Area (square meters)"
BIOMASS_WET = "Residue plus Grain Wet Weight (grams)"
GRAIN_WET_IN_RESIDUE = "Residue sample Grain Wet Weight (grams)"
SUB_WET = "Residue Sub-Sample Wet Weight (grams)"
SUB_DRY = "Residue Sub-Sample Dry Weight (grams)"
TOTAL_DRY = "total grain yield dry (grams)"
TOTAL_AREA = "total area harvested (M2)"

# Samples recorded at the wrong point, and strips whose crop failed.
MISPLACED = [
    ("Row Letter", [({"Year": 2008, "Sample Location ID": 338}, "H"), ({"Year": 2008, "Sample Location ID": 192}, None)]),
    ("Column", [({"Year": 2008, "Sample Location ID": 338}, 23), ({"Year": 2008, "Sample Location ID": 192}, None)]),
    ("Strip", [({"Year": 2008, "Sample Location ID": 338}, 2)]),
]
REPLANTED = [
    (
        "Crop",
        [
            ({"Year": 2001, "Field": "A", "Strip": 3}, "SC"),
            ({"Year": 2004, "Field": "A", "Strip": 3}, "SC"),
            ({"Year": 2008, "Field": "A", "Strip": 4}, "SC"),
        ],
    ),
    ("Crop", [({"Year": 2001, "ID2": 227}, "WP")]),
]


def _legacy_with_reanalysis(legacy: DataFrame, again: DataFrame) -> DataFrame:
    grid = legacy.where(F.lower("Project") == "grid points").withColumn(
        "Column", as_col("Column").try_cast("int")
    )
    joined = attach(grid, again, {"Year": "Year", "Column": "Column", "Row Letter": "Row2"})
    return joined.withColumns(
        {
            "GrainNFinal": prefer(within("GrainNitrogen", 0, 100), within(N_LEGACY, 0, 100)),
            "GrainCFinal": prefer(within("GrainCarbon", 0, 100), within(C_LEGACY, 0, 100)),
        }
    )


def legacy_uncorrected(legacy: DataFrame, again: DataFrame, points: DataFrame) -> DataFrame:
    """First years as recorded: no reassignment, residue calculated in place."""
    joined = _legacy_with_reanalysis(legacy, again).withColumns(
        {
            **{c: zero_to_null(c) for c in (TOTAL_AREA, BIOMASS_WET, SUB_DRY, SUB_WET, RESIDUE_AREA)},
            "GrainMassFinal": positive(TOTAL_DRY),
        }
    )
    located = locate(joined, points, "Row Letter", "Column")
    return located.withColumn(
        "GrainYieldDryPerArea", as_col("GrainMassFinal") / as_col(TOTAL_AREA)
    ).withColumns(residue_set(BIOMASS_WET, GRAIN_WET_IN_RESIDUE, SUB_WET, SUB_DRY, RESIDUE_AREA))


def harvest_1999_2009(legacy: DataFrame, again: DataFrame, points: DataFrame) -> DataFrame:
    """First years: best of two sources, masses kept by sampling mode, known mistakes fixed."""
    areas = (GRAIN_AREA, RESIDUE_AREA)
    joined = _legacy_with_reanalysis(legacy, again).withColumns(
        {
            "GrainSampleArea": as_col(GRAIN_AREA),
            "BiomassSampleArea": as_col(RESIDUE_AREA),
            "GrainMassWetInGrainSample": keep_part("Non-Residue Grain Wet Weight (grams)", *areas),
            "GrainMassAirDryInGrainSample": keep_part("Non-Residue grain dry weight (grams)", *areas),
            "BiomassWet": as_col(BIOMASS_WET),
            "GrainMassWetInBiomassSample": as_col(GRAIN_WET_IN_RESIDUE),
            "GrainMassAirDryInBiomassSample": keep_part("Residue sample Grain Dry Weight (grams)", *areas),
            "ResidueMassWetSubsample": as_col(SUB_WET),
            "ResidueMassAirDrySubsample": as_col(SUB_DRY),
            "GrainMassWet": keep_total("total grain yield wet(grams)", *areas),
            "GrainMassAirDry": keep_total(TOTAL_DRY, *areas),
        }
    )
    for column, cases in MISPLACED:
        joined = correct(joined, column, cases)
    located = locate(joined, points, "Row Letter", "Column").where(
        F.col("ID2").isNotNull() & (F.lower("Crop") != "fallow")
    )
    coded = recode(located, CROP_CODES).drop("GrainCarbon", "GrainNitrogen")
    coded = coded.withColumn(
        "Comments", prefer("Grain Harvest Comments", "Residue Sample Comments")
    )
    return harmonise(
        coded,
        Harvest(
            corrections=REPLANTED,
            renames={
                "Year": "HarvestYear",
                "X": "Longitude",
                "Y": "Latitude",
                "GrainCFinal": "GrainCarbon",
                "GrainNFinal": "GrainNitrogen",
                "Grain Sulfur %...12": "GrainSulfur",
                "Residue Carbon %": "ResidueCarbon",
                "Residue Nitrogen %": "ResidueNitrogen",
                "Residue Sulfur %": "ResidueSulfur",
            },
        ),
    )


# ---- single years ---------------------------------------------------------------

# Sheet column names of the single years.
HARVEST_2010 = Harvest(
    corrections=[("Grain Type", [({"Field": "A", "Strip": 1}, "WW")])],
    renames={
        "Year": "HarvestYear",
        "Grain Type": "Crop",
        "Bag Barcode": "SampleID",
        "X": "Longitude",
        "Y": "Latitude",
        "Total Grain Wet (g)": "GrainMassWet",
        "Total Grain Dry (g)": "GrainMassAirDry",
    },
    biomass="BiomassWet",
    grain="GrainMassWet",
    area="Area (m2)",
    required=["ID2"],
)

HARVEST_2011 = Harvest(
    notes=[
        ("Residue note", "Total Residue and Grain Wet (g)", " "),
        ("Grain note", "Total Grain Wet (g)", ""),
        ("NIR note", "Test weight", ""),
    ],
    numbers=["Total Residue and Grain Wet (g)", "Total Grain Wet (g)", "Test weight"],
    renames={
        "Year": "HarvestYear",
        "Current Crop": "Crop",
        "X": "Longitude",
        "Y": "Latitude",
        "ProtDM": "GrainProtein",
        "Moisture": "GrainMoisture",
        "StarchDM": "GrainStarch",
        "WGlutDM": "GrainWGlutDM",
        "Total Residue and Grain Wet (g)": "BiomassWet",
        "Total Grain Wet (g)": "GrainMassWet",
        "Test weight": "GrainTestWeight",
    },
    biomass="BiomassWet",
    grain="GrainMassWet",
    area="Area (m2)",
)

HARVEST_2012 = Harvest(
    constants={"HarvestYear": 2012},
    renames={
        "X": "Longitude",
        "Y": "Latitude",
        "ID2.x": "ID2",
        "Protein": "GrainProtein",
        "Moisture": "GrainMoisture",
        "Starch": "GrainStarch",
        "Gluten": "GrainWGlutDM",
        "Test Weight": "GrainTestWeight",
        "Grain Weight Wet (g)": "GrainMassWet",
        "Grain Weight Dry (g)": "GrainMassAirDry",
        "Total Biomass Wet (g)": "BiomassWet",
    },
    codes={"SL": "GB"},
    biomass="BiomassWet",
    grain="GrainMassWet",
    area="Area (m2)",
)

HARVEST_2013 = Harvest(
    required=["SampleID"],
    renames={
        "Year": "HarvestYear",
        "Protein": "GrainProtein",
        "Moisture": "GrainMoisture",
        "Starch": "GrainStarch",
        "WGlutDM": "GrainWGlutDM",
        "Notes": "Comments",
        "TestWeight": "GrainTestWeight",
        "GrainWeightWet": "GrainMassAirDry",  # greenhouse-dried mass, misnamed in the sheet
    },
    biomass="BiomassAirDry",
    grain="GrainMassAirDry",
    area="Area",
)

HARVEST_2014_REPLICATES = Harvest(
    constants={"HarvestYear": 2014},
    renames={
        "BarcodeFinal": "SampleID",
        "TotalGrain.g.": "GrainMassAirDry",
        "protein": "GrainProtein",
        "moisture": "GrainMoisture",
        "starch": "GrainStarch",
        "gluten": "GrainWGlutDM",
        "testWeight": "GrainTestWeight",
        "X": "Longitude",
        "Y": "Latitude",
        "biomass": "BiomassAirDry",
    },
    biomass="BiomassAirDry",
    grain="GrainMassAirDry",
    area=PIPE_AREA,
)

HARVEST_2014 = Harvest(biomass="BiomassAirDry", grain="GrainMassAirDry", area=PIPE_AREA)

HARVEST_2015 = Harvest(
    corrections=[("Crop", [({"ID2": 258}, "SC")])],
    renames={
        "Barcode": "SampleID",
        "Oil (DM)": "GrainOilDM",
        "Protein (%)": "GrainProtein",
        "Moisture (%)": "GrainMoisture",
        "Starch (%)": "GrainStarch",
        "WGlutDM": "GrainWGlutDM",
        "TestWeight (g)": "GrainTestWeight",
        "Notes": "Comments",
        "GrainNetWt (g)": "GrainMassAirDry",
        "NetWt (g)": "BiomassAirDry",
    },
    biomass="BiomassAirDry",
    grain="GrainMassAirDry",
    area="by_crop",
)

HARVEST_2016 = Harvest(
    renames={
        "Barcode": "SampleID",
        "NotesValue": "Comments",
        "GrainNetWt (g)": "GrainMassAirDry",
        "NetWt (g)": "BiomassAirDry",
    },
    biomass="BiomassAirDry",
    grain="GrainMassAirDry",
    area="by_crop",
)


def harvest_2010(grain: DataFrame, residue: DataFrame, points: DataFrame) -> DataFrame:
    """Grain and residue sheets joined on the upper-cased barcode."""
    barcode = "Bag Barcode"
    grain = grain.withColumn(barcode, F.upper(as_col(barcode)))
    slim = (
        residue.where(
            (F.col("Project") == "GP")
            & as_col("Total Biomass Wet (g)").isNotNull()
            & as_col("Total Grain Wet (g)").isNotNull()
            & (as_col("Residue Sub Wet (g)") > 0)
        )
        .select(
            F.upper(as_col(barcode)).alias(barcode),
            as_col("Total Biomass Wet (g)").alias("BiomassWet"),
            as_col("Residue Sub Wet (g)").alias("ResidueMassWetSubsample"),
            as_col("Sub Res Dry (g)").alias("ResidueMassAirDrySubsample"),
        )
    )
    located = staged(locate(grain, points, "Row", "Column").withColumnRenamed(barcode, "Barcode"))
    joined = full_attach(located, slim.withColumnRenamed(barcode, "Barcode"), ["Barcode"])
    return harmonise(joined.withColumnRenamed("Barcode", barcode), HARVEST_2010)


def has_place(id_column: str, row: str, column: str) -> Column:
    return as_col(id_column).isNotNull() | (as_col(row).isNotNull() & as_col(column).isNotNull())


# Measures that the two files of 2011 both hold.
SHARED_2011 = ["Total Grain Wet (g)", "Total Residue and Grain Wet (g)", "Area (m2)"]


def warn_of_mismatches(counts: DataFrame, what: str) -> None:
    """Warn of the measures whose count of differing rows is not zero."""
    row = counts.first().asDict()
    wrong = {m: n for m, n in row.items() if m != "rows_compared" and n}
    if wrong:
        warnings.warn(f"{what} differ: {wrong} of {row.get('rows_compared')} rows", stacklevel=2)


def harvest_2011(
    sheet: DataFrame, points: DataFrame, analysis: DataFrame | None = None
) -> DataFrame:
    """The yield sheet; ``analysis`` repeats its masses, and differences give a warning."""
    placed = sheet.where(has_place("UID", "Row", "Column")).withColumn(
        "SampleID", F.upper("Barcode")
    )
    if analysis is not None:
        again = analysis.where(has_place("UID", "Row", "Column"))
        mine, theirs = (
            df.select("UID", *[as_col(m).try_cast("double").alias(m) for m in SHARED_2011])
            for df in (placed, again)
        )
        counts = measure_mismatches(mine, theirs, ["UID"], SHARED_2011, 0.0)
        warn_of_mismatches(counts, "masses of the two files")
    return harmonise(locate(placed, points, "Row", "Column"), HARVEST_2011)


def harvest_2012(sheet: DataFrame, points: DataFrame, remark: str = "...24") -> DataFrame:
    """The sheet's own id is kept beside the point's; an unnamed column holds remarks."""
    placed = sheet.where(has_place("ID2", "ROW2", "COLUMN")).withColumns(
        {
            "SampleID": F.upper("Barcode"),
            "Comments": append_notes(
                ("TestWeight note", note_in("Test Weight"), " "),
                ("Sample note", as_col(remark), ""),
            ),
            "Test Weight": number_in("Test Weight"),
        }
    )
    own_id = placed.withColumnRenamed("ID2", "ID2.x")
    return harmonise(
        locate(own_id, points.withColumnRenamed("ID2", "ID2.y"), "ROW2", "COLUMN"), HARVEST_2012
    )


def analyses(*blocks: tuple[DataFrame, str, str | None, dict[str, str]]) -> DataFrame:
    """Lab results of several layouts as one table of distinct rows.

    A block is (rows, id column, id marker to remove, {column: measure}).
    """
    parts = []
    for df, id_column, marker, measures in blocks:
        sample = as_col(id_column) if marker is None else remove_first(id_column, marker)
        parts.append(
            df.select(
                F.upper(sample).alias("SampleID"),
                *[number_in(remove_first(as_col(c).cast("string"), " !")).alias(m) for c, m in measures.items()],
            )
        )
    return union_diagonal(*parts).distinct()


def harvest_2013(yields: DataFrame, grain: DataFrame, residue: DataFrame) -> DataFrame:
    """Yield sheet with grain and residue analyses by sample id."""
    own = yields.withColumn("SampleID", F.upper("SampleID"))
    joined = attach(attach(own, grain, ["SampleID"]), residue, ["SampleID"])
    return harmonise(joined, HARVEST_2013)


def replicate_table(reps: DataFrame, points: DataFrame, order: list[str]) -> DataFrame:
    """2014: one weighed bag per point, preferring bags with lab analysis."""
    own = reps.drop("ShouldKeep").withColumnRenamed("ID2", "ID2.x")
    located = locate(own, points, "Row2", "Col").where(F.col("ID2").isNotNull())
    chosen = choose_replicates(
        located,
        "ID2",
        [
            F.col("protein").isNotNull(),
            F.year(date_of_serial("LastSaved")) >= 2015,
            as_col("TareBag.g..1").isNotNull(),
        ],
        "TotalGrain.g.",
        order,
    )
    biomass = located.select(
        "ID2",
        prefer("TotalBiomass.g.", as_col("Tota.Biomass.g..bag") - as_col("TareBag.g..1")).alias("biomass"),
    ).where(F.col("biomass").isNotNull())
    joined = attach(chosen, biomass, ["ID2"]).withColumn(
        "Comments", paste("NOTES", "Notes2", "Notes3", sep=" | ")
    )
    return harmonise(joined, HARVEST_2014_REPLICATES)


def coded_sample(sheet: DataFrame) -> DataFrame:
    """Grid column and row from a sample id like ``X_1_23-H_RES``."""
    pieces = split_pieces("SampleID", "_", ["SamplePrefix", "ID", "ColRow2", "IsRes"])
    place = split_pieces(pieces["ColRow2"], "-", ["Column", "Row2"])
    return sheet.withColumns({"Column": place["Column"].try_cast("int"), "Row2": place["Row2"]})


def built_sample(sheet: DataFrame) -> DataFrame:
    """Sample id from its parts: ``sample_column-row``."""
    return sheet.withColumn("SampleID", paste("Sample", paste("Column", "Row2", sep="-"), sep="_"))


def harvest_2014(
    sheets: dict[str, DataFrame], replicates: DataFrame, points: DataFrame, order: list[str]
) -> DataFrame:
    """Four crop sheets, residue and grain bags of a sample merged, beside the replicates.

    ``sheets`` maps a crop to its rows; ``order`` is their file order.
    """
    parts = [df.withColumn("Crop", F.lit(crop)) for crop, df in sheets.items()]
    rows = union_diagonal(*parts).withColumns(
        {"HarvestYear": F.lit(2014), "SampleID": remove_first("SampleID", "_RES")}
    )
    one = first_non_null(rows, ["SampleID"], order)
    located = locate(one, points, "Row2", "Column").withColumnsRenamed(
        {"X": "Longitude", "Y": "Latitude"}
    )
    lab = replicates.select(
        "ID2",
        "GrainProtein",
        "GrainMoisture",
        "GrainStarch",
        "GrainWGlutDM",
        "GrainTestWeight",
        "BiomassAirDry",
        "GrainMassAirDry",
        "Comments",
    )
    both = merge_sides(lab, located, "ID2", "ID2", how="left")
    chosen = both.withColumns(
        {
            **{
                m: as_col(m + ".x") if m + ".x" in both.columns else as_col(m)
                for m in ("GrainProtein", "GrainMoisture", "GrainStarch", "GrainWGlutDM", "GrainTestWeight")
            },
            "BiomassAirDry": prefer("BiomassAirDry.y", "BiomassAirDry.x"),
            "GrainMassAirDry": prefer("GrainMassAirDry.y", "GrainMassAirDry.x"),
            "Comments": paste("Comments.x", "Comments.y", sep=" | "),
        }
    )
    return harmonise(chosen, HARVEST_2014)


def harvest_2015(sheet: DataFrame) -> DataFrame:
    return harmonise(sheet, HARVEST_2015)


# Grain and biomass masses of the sheet and of the lab tables.
MASSES_2016 = [("GrainNetWt (g)", "Grain Net Wt. (g)"), ("NetWt (g)", "Net Wt. (g)")]


def harvest_2016(sheet: DataFrame, lab: list[DataFrame]) -> DataFrame:
    """Sheet and lab tables by barcode; the sheet's analysis is preferred.

    Masses that both hold are compared, and differences give a warning.
    """
    joined = merge_sides(
        sheet.where(F.col("ID2").isNotNull()), union_diagonal(*lab), "Barcode", "Sample"
    )
    masses = [p for p in MASSES_2016 if set(p) <= set(joined.columns)]
    if masses:
        off = [
            F.count_if(
                F.coalesce(
                    F.abs(as_col(a).try_cast("double") - as_col(b).try_cast("double")) > 0.0,
                    F.lit(False),
                )
            ).alias(a)
            for a, b in masses
        ]
        warn_of_mismatches(joined.agg(F.count("*").alias("rows_compared"), *off), "masses")
    pairs = {
        "GrainOilDM": ("Oil (DM).x", "Oil (DM).y"),
        "GrainProtein": ("Protein (%)", "ProtDM"),
        "GrainMoisture": ("Moisture (%)", "Moisture"),
        "GrainStarch": ("Starch (%)", "StarchDM"),
        "GrainWGlutDM": ("WGlutDM.x", "WGlutDM.y"),
        "GrainTestWeight": ("TestWeight (g)", "Infartec 1241 Test Weight"),
    }
    return harmonise(
        joined.withColumns({m: prefer(a, b) for m, (a, b) in pairs.items()}), HARVEST_2016
    )


# ---- all years ---------------------------------------------------------------


def all_years(*harvests: DataFrame) -> DataFrame:
    """One table of every year's rows."""
    return union_diagonal(*harvests)


def raw_table(
    samples: DataFrame, crop_present: DataFrame, points: DataFrame, base_year: int = 1999
) -> DataFrame:
    """P1A0: crop-present code, missing grid points appended, the 32 sample columns."""
    coded = attach(samples, crop_present, ["HarvestYear", "ID2"])
    for c, t in SAMPLE_COLUMNS.items():
        if c not in coded.columns:
            coded = coded.withColumn(c, F.lit(None).cast(t))
    full = append_missing(coded, points, base_year)
    return full.select(*[F.col(quoted(c)).cast(t).alias(c) for c, t in SAMPLE_COLUMNS.items()])
