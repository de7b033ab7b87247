"""The numbers behind density and Q-Q plots, per group, without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stubble.functions import as_col
from stubble.functions.normal import normal_density, normal_quantile
from stubble.operators.joins import attach
from stubble.operators.quantiles import exact_quantiles, quantile_name
from stubble.operators.staging import staged

#: Plotting positions of a Q-Q plot: the middles of so many equal shares.
POSITIONS = 20


def plotting_positions(n: int = POSITIONS) -> list[float]:
    return [(i + 0.5) / n for i in range(n)]


def _values(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Staged rows with a finite value, which every step reads again."""
    v = as_col(column).cast("double")
    rows = df.select(*keys, v.alias("__v"))
    return staged(rows.where(F.abs("__v") < F.lit(float("inf"))))


def qq_points(df: DataFrame, keys: list[str], column: str, positions: int = POSITIONS) -> DataFrame:
    """``probability, theoretical, fitted, sample`` per group and plotting position.

    ``sample`` is the exact quantile, ``theoretical`` the standard normal one, ``fitted`` the
    one of the normal distribution with the group's mean and deviation (null for one value).
    """
    rows = _values(df, keys, column)
    probs = plotting_positions(positions)
    found = exact_quantiles(rows, keys, ["__v"], probs)
    moments = staged(rows.groupBy(*keys).agg(F.avg("__v").alias("__mean"), F.stddev_samp("__v").alias("__sd")))
    points = F.array(
        *[F.struct(F.lit(p).alias("probability"), F.col(f"`{quantile_name('__v', p)}`").alias("sample")) for p in probs]
    )
    z = normal_quantile("probability")
    return (
        attach(found, moments, keys)
        .select(*keys, "__mean", "__sd", F.inline(points))
        .select(
            *keys, "probability", z.alias("theoretical"), (F.col("__mean") + z * F.col("__sd")).alias("fitted"), "sample"
        )
    )


def density(df: DataFrame, keys: list[str], column: str, points: int = 64, cut: float = 3.0) -> DataFrame:
    """``at, density`` at equally spaced points per group: a normal kernel over binned values.

    The bandwidth is 0.9 times the smaller of the deviation and the quartile distance over
    1.34 (a zero falls back to the deviation, then to the size of the smallest value, then to
    1), times n to the power of -1/5. The points reach ``cut`` bandwidths beyond the extremes.
    Every value is shared between the two points around it, and the shares, summed per point,
    are spread by the kernel: a group is at most ``points`` numbers by then. Groups of fewer
    than two values have no density.
    """
    rows = _values(df, keys, column)
    low, high = quantile_name("__v", 0.25), quantile_name("__v", 0.75)
    ends = rows.groupBy(*keys).agg(F.stddev_samp("__v").alias("sd"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    quartiles = exact_quantiles(rows, keys, ["__v"], [0.25, 0.75]).withColumnRenamed("__v_n", "n")
    spread = F.least("sd", (F.col(high) - F.col(low)) / 1.34)
    width = F.coalesce(*[F.nullif(w, F.lit(0.0)) for w in (spread, F.col("sd"), F.abs("lo"))], F.lit(1.0))
    groups = attach(quartiles, staged(ends), keys).where("n > 1").withColumn("__bw", 0.9 * width * F.pow("n", F.lit(-0.2)))
    reach = F.col("__bw") * cut
    grid = staged(
        groups.select(
            *keys,
            "__bw",
            F.col("n").alias("__n"),
            (F.col("lo") - reach).alias("__from"),
            ((F.col("hi") - F.col("lo") + 2 * reach) / (points - 1)).alias("__step"),
        )
    )
    place = (F.col("__v") - F.col("__from")) / F.col("__step")
    at = F.least(F.floor(place), F.lit(points - 2)).cast("int")
    shares = F.array(
        F.struct(at.alias("__at"), (1 - (place - at)).alias("__share")),
        F.struct((at + 1).alias("__at"), (place - at).alias("__share")),
    )
    binned = (
        attach(rows, grid, keys, "inner")
        .select(*keys, F.inline(shares))
        .groupBy(*keys, "__at")
        .agg(F.sum("__share").alias("__share"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("__at", "__share"))).alias("__bins"))
    )
    spots = attach(grid, binned, keys, "inner").withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    scale = F.col("__step") / F.col("__bw")
    total = F.aggregate(
        "__bins",
        F.lit(0.0),
        lambda sum_, b: sum_ + b["__share"] * normal_density((F.col("__i") - b["__at"]) * scale),
    )
    return spots.select(
        *keys,
        (F.col("__from") + F.col("__i") * F.col("__step")).alias("at"),
        (total / (F.col("__n") * F.col("__bw"))).alias("density"),
    )
