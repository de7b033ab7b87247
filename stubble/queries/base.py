"""Registry, table access and the sample view shared by the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stubble.operators.columns import add_level

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that must agree with it."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is inferred once and then given, which saves a job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# A value on a rounding tie would be decided by the last bit of a sum, which depends on
# the order of addition; the factor takes ties off the edge in both engines alike.
_OFF_TIES = "1.000000000001"


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded for comparison (half up, never -0.0)."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    grid = F.lit(10.0**places)

    def near(c: str):
        scaled = F.col(f"`{c}`").cast("double") * grid * F.lit(float(_OFF_TIES))
        return F.floor(scaled + F.lit(0.5)) / grid

    return df.withColumns({c: near(c) for c in doubles})


def r(expression: str, places: int = 4) -> str:
    """The SQL twin of ``rounded``."""
    grid = f"CAST(1e{places} AS DOUBLE)"
    scaled = f"CAST({expression} AS DOUBLE) * {grid} * CAST({_OFF_TIES} AS DOUBLE)"
    return f"(floor({scaled} + CAST(0.5 AS DOUBLE)) / {grid})"


def values(rows: list[tuple], columns: str) -> str:
    """A SQL VALUES list as a named table expression."""

    def cell(v):
        if v is None:
            return "NULL"
        return f"'{v}'" if isinstance(v, str) else repr(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {columns}"


MEASURES = [
    "GrainSampleArea",
    "GrainMassWet",
    "GrainMassAirDry",
    "GrainMassWetInGrainSample",
    "GrainMassAirDryInGrainSample",
    "BiomassSampleArea",
    "BiomassWet",
    "BiomassAirDry",
    "GrainMassWetInBiomassSample",
    "GrainMassAirDryInBiomassSample",
    "ResidueMassWetSubsample",
    "ResidueMassAirDrySubsample",
]


def cents(column: str):
    """Hundredths as whole numbers, so that sums are exact in any order."""
    return F.rint(F.col(column) * 100).cast("bigint")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One survey sample per order; a measure without line items is null.

    Line items are summed per order first: the partial sums shrink the shuffle, a hot
    order cannot fill a task, and the join then needs no second shuffle of that side.
    """
    price, kept, tax = cents("l_extendedprice"), 100 - cents("l_discount"), cents("l_tax")

    def total(flag: str, value, unit: float = 1.0):
        return F.sum(F.when(F.col("l_returnflag") == flag, value)) / F.lit(unit)

    per_order = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            total("A", F.col("l_quantity")).alias("GrainSampleArea"),
            total("A", price, 1e2).alias("GrainMassWet"),
            total("A", price * kept, 1e4).alias("GrainMassAirDry"),
            total("R", F.col("l_quantity")).alias("BiomassSampleArea"),
            total("R", price, 1e2).alias("BiomassWet"),
            total("R", price * kept, 1e4).alias("BiomassAirDry"),
            total("R", price * tax, 1e4).alias("GrainMassWetInBiomassSample"),
            total("R", price * tax * kept, 1e6).alias("GrainMassAirDryInBiomassSample"),
            total("N", price, 1e2).alias("ResidueMassWetSubsample"),
            total("N", price * kept, 1e4).alias("ResidueMassAirDrySubsample"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("HarvestYear"), "o_orderpriority"
    )
    return (
        orders.join(per_order, orders["o_orderkey"] == per_order["l_orderkey"], "left")
        .withColumns(
            {
                "GrainMassWetInGrainSample": F.col("GrainMassWet"),
                "GrainMassAirDryInGrainSample": F.col("GrainMassAirDry"),
            }
        )
        .select(
            "HarvestYear",
            F.col("o_orderkey").alias("ID2"),
            F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("Crop"),
            *MEASURES,
        )
    )


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample view with raw-level names."""
    return add_level(samples(spark, sf_dir), 1)


S = """s AS (
  SELECT CAST(year(o_orderdate) AS INT) AS HarvestYear, o_orderkey AS ID2,
    nullif(o_orderpriority, '4-NOT SPECIFIED') AS Crop,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS DOUBLE) AS GrainSampleArea,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN p END) AS DOUBLE) AS GrainMassWet,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN p * (1 - d) END) AS DOUBLE) AS GrainMassAirDry,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN p END) AS DOUBLE) AS GrainMassWetInGrainSample,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN p * (1 - d) END) AS DOUBLE)
      AS GrainMassAirDryInGrainSample,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS DOUBLE) AS BiomassSampleArea,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN p END) AS DOUBLE) AS BiomassWet,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN p * (1 - d) END) AS DOUBLE) AS BiomassAirDry,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN p * t END) AS DOUBLE)
      AS GrainMassWetInBiomassSample,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN p * t * (1 - d) END) AS DOUBLE)
      AS GrainMassAirDryInBiomassSample,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN p END) AS DOUBLE) AS ResidueMassWetSubsample,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN p * (1 - d) END) AS DOUBLE)
      AS ResidueMassAirDrySubsample
  FROM orders LEFT JOIN (
    SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d,
      CAST(l_tax AS DECIMAL(4,2)) AS t FROM lineitem) ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_orderdate, o_orderpriority)"""

# Calculated measures with every year under the rules by sampling mode.
CALC = f"""{S}, m AS (
  SELECT *, CASE WHEN coalesce(GrainSampleArea, 0) > 0 AND coalesce(BiomassSampleArea, 0) > 0
      THEN 'both'
    WHEN coalesce(GrainSampleArea, 0) > 0 THEN 'grain'
    WHEN coalesce(BiomassSampleArea, 0) > 0 THEN 'biomass' ELSE 'neither' END AS mode
  FROM s), g AS (
  SELECT *, CASE mode WHEN 'biomass' THEN GrainMassWetInBiomassSample
      ELSE GrainMassWet END AS w,
    CASE mode WHEN 'biomass' THEN GrainMassAirDryInBiomassSample ELSE GrainMassAirDry END AS a,
    CASE mode WHEN 'both' THEN GrainSampleArea + BiomassSampleArea
      WHEN 'grain' THEN GrainSampleArea WHEN 'biomass' THEN BiomassSampleArea END AS ar,
    CASE WHEN mode IN ('both', 'biomass') AND BiomassWet > 0
      THEN BiomassWet - GrainMassWetInBiomassSample END AS rw,
    CASE WHEN mode IN ('both', 'biomass') AND ResidueMassWetSubsample > 0
      THEN (ResidueMassWetSubsample - ResidueMassAirDrySubsample) / ResidueMassWetSubsample
      END AS rm
  FROM m), c AS (
  SELECT HarvestYear, ID2, Crop, mode, GrainMassWet, GrainSampleArea, BiomassSampleArea,
    w / nullif(ar, 0) AS GrainYieldWet_P2, a / nullif(ar, 0) AS GrainYieldAirDry_P2,
    CASE WHEN w > 0 THEN (w - a) / w END AS GrainMoistureProportionPartial_P2,
    CASE WHEN mode = 'both' THEN GrainMassWet - GrainMassWetInBiomassSample END
      AS GrainMassWetInGrainSample_P2,
    CASE WHEN mode = 'both' AND w > 0 THEN (GrainMassWet - GrainMassWetInBiomassSample)
      * (1 - (w - a) / w) END AS GrainMassAirDryInGrainSample_P2,
    CASE WHEN mode = 'both' AND w > 0 THEN GrainMassWetInBiomassSample * (1 - (w - a) / w) END
      AS GrainMassAirDryInBiomassSample_P2,
    rw AS ResidueMassWet_P2, rm AS ResidueMoistureProportionPartialSubsample_P2,
    rw - rw * rm AS ResidueMassAirDry_P2,
    CASE WHEN BiomassSampleArea > 0 THEN rw / BiomassSampleArea END AS ResidueMassWetPerArea_P2,
    CASE WHEN BiomassSampleArea > 0 THEN (rw - rw * rm) / BiomassSampleArea END
      AS ResidueMassAirDryPerArea_P2
  FROM g)"""
