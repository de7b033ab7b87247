"""CSV tables: samples and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stubble.operators.columns import clean_numbers

# The raw sample table, in file order (ids widened to 64 bits).
SAMPLE_COLUMNS = {
    "HarvestYear": "int",
    "ID2": "bigint",
    "Longitude": "double",
    "Latitude": "double",
    "SampleID": "string",
    "Crop": "string",
    "GrainSampleArea": "double",
    "GrainMassWet": "double",
    "GrainMassWetInGrainSample": "double",
    "GrainMassAirDryInGrainSample": "double",
    "GrainMassAirDry": "double",
    "GrainMoisture": "double",
    "GrainProtein": "double",
    "GrainStarch": "double",
    "GrainWGlutDM": "double",
    "GrainOilDM": "double",
    "GrainTestWeight": "double",
    "GrainCarbon": "double",
    "GrainNitrogen": "double",
    "GrainSulfur": "double",
    "BiomassSampleArea": "double",
    "BiomassWet": "double",
    "BiomassAirDry": "double",
    "GrainMassWetInBiomassSample": "double",
    "GrainMassAirDryInBiomassSample": "double",
    "ResidueMassWetSubsample": "double",
    "ResidueMassAirDrySubsample": "double",
    "ResidueCarbon": "double",
    "ResidueNitrogen": "double",
    "ResidueSulfur": "double",
    "CropExists": "int",
    "Comments": "string",
}

EDIT_COLUMNS = "ID string, Verb string, Variable string, NewVal double, Comment string, Reviewer string"
BOUNDS_COLUMNS = "Crop string, FieldName string, Lower double, Upper double, Reference string"
OBSERVATION_COLUMNS = (
    "Crop string, FieldName string, AffectedColumns string, "
    "Lower double, Upper double, Reference string"
)
HI_COLUMNS = "Crop string, HIMin double, HIMax double"


def sample_schema() -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in SAMPLE_COLUMNS.items()))


def _csv(spark: SparkSession, path, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_samples(spark: SparkSession, path) -> DataFrame:
    """The raw sample table with its fixed schema; NaN becomes null."""
    return clean_numbers(_csv(spark, path, sample_schema()))


def read_inferred(spark: SparkSession, path, sampling: float = 1.0) -> DataFrame:
    """A table of unknown types; only for review jobs, as it reads the data twice."""
    return clean_numbers(
        spark.read.option("header", True)
        .option("escape", '"')
        .option("inferSchema", True)
        .option("samplingRatio", sampling)
        .csv(path)
    )


def _in_file_order(df: DataFrame) -> DataFrame:
    """``seq`` orders rows as in the file: block of the file, then row in the block."""
    return df.select(
        "*",
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
    )


def read_edits(spark: SparkSession, path) -> DataFrame:
    """Reviewed edits in file order; a file with only a header is legal."""
    return _in_file_order(_csv(spark, path, EDIT_COLUMNS))


def read_bounds(spark: SparkSession, path) -> DataFrame:
    """Point bounds in file order; rules without both bounds are left out."""
    return _in_file_order(_csv(spark, path, BOUNDS_COLUMNS)).na.drop(subset=["Lower", "Upper"])


def read_observation_rules(spark: SparkSession, path) -> DataFrame:
    """Bounds of derived values with the columns they affect (comma list)."""
    rules = _in_file_order(_csv(spark, path, OBSERVATION_COLUMNS))
    return rules.na.drop(subset=["Lower", "Upper"])


def one_rule_per_column(rules: DataFrame) -> DataFrame:
    """Fan out the comma list: one rule per affected column."""
    return rules.withColumn(
        "AffectedColumn", F.explode(F.split("AffectedColumns", ","))
    ).withColumn("AffectedColumn", F.trim("AffectedColumn"))


def read_hi_bounds(spark: SparkSession, path) -> DataFrame:
    return _csv(spark, path, HI_COLUMNS)
