"""Group summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stubble.functions import as_col
from stubble.operators.joins import attach, attach_group_stats
from stubble.operators.quantiles import quantile_name, quartiles
from stubble.operators.staging import staged


def conditional_mean(value, condition: Column) -> Column:
    """Mean over the rows that meet a condition; NaN and null are skipped."""
    return F.avg(F.when(condition, F.nanvl(as_col(value), F.lit(None))))


def numeric_columns(df: DataFrame, leave_out: list[str] = ()) -> list[str]:
    kinds = ("double", "float", "integer", "long", "short", "byte", "decimal")
    return [
        f.name
        for f in df.schema.fields
        if f.dataType.typeName().split("(")[0] in kinds and f.name not in leave_out
    ]


def means_by(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Mean of every numeric measure per group, named ``{column}_mean``."""
    columns = columns if columns is not None else numeric_columns(df, keys)
    return df.groupBy(*keys).agg(*[F.avg(as_col(c)).alias(f"{c}_mean") for c in columns])


def band_of(year, bands: list[tuple[int, int]]) -> Column:
    """Label ``lo-hi`` of the inclusive band that holds a year, else null."""
    y = as_col(year)
    expr = F.lit(None).cast("string")
    for lo, hi in reversed(bands):
        expr = F.when(y.between(lo, hi), F.lit(f"{lo}-{hi}")).otherwise(expr)
    return expr


def era_means(
    df: DataFrame, year: str, crop: str, columns: list[str], bands: list[tuple[int, int]]
) -> DataFrame:
    """Means per crop and year band; years outside every band take no part."""
    return (
        df.withColumn("Era", band_of(year, bands))
        .where(F.col("Era").isNotNull())
        .groupBy(crop, "Era")
        .agg(*[F.avg(as_col(c)).alias(f"{c}_mean") for c in columns])
    )


def mean_sd_se(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean, sample deviation, standard error and count over non-null values."""
    v = as_col(column)
    return (
        df.where(v.isNotNull())
        .groupBy(*keys)
        .agg(
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("sd"),
            (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("se"),
            F.count("*").alias("n_samples"),
        )
    )


def side_by_side(
    df: DataFrame, keys: list[str], columns: dict[str, str], with_max: bool = False
) -> DataFrame:
    """Summaries of several sources: ``{suffix: column}``.

    The standard error divides by all rows of the group; n counts non-null values.
    """
    aggs = []
    for suffix, c in columns.items():
        v = as_col(c)
        aggs += [F.max(v).alias(f"max{suffix}")] if with_max else []
        aggs += [
            F.avg(v).alias(f"mean{suffix}"),
            (F.stddev_samp(v) / F.sqrt(F.count(F.lit(1)))).alias(f"se{suffix}"),
            F.count(v).alias(f"n{suffix}"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def with_group_mean(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Attach the group mean of a column to every row."""
    means = df.groupBy(*keys).agg(F.avg(as_col(column)).alias(name))
    return attach_group_stats(df, means, keys)


def tier_sums(value) -> list[Column]:
    """Sum and count of a value per fine group, for ``tier_mean``."""
    v = F.nanvl(as_col(value).cast("double"), F.lit(None))
    return [F.sum(v).alias("__sum"), F.count(v).alias("__count")]


def tier_mean(coarse: list[str]) -> Column:
    """Mean of the fine group, or of its coarse group when it has no value.

    Works on the few rows of a per-group table, so the large table is aggregated once.
    """
    wide = Window.partitionBy(*coarse)
    total, count = F.sum("__sum").over(wide), F.sum("__count").over(wide)
    return F.when(F.col("__count") > 0, F.col("__sum") / F.col("__count")).when(
        count > 0, total / count
    )


def with_tiered_mean(
    df: DataFrame, fine: list[str], coarse: list[str], value, name: str
) -> DataFrame:
    """Attach the mean of the fine group, else of the coarse group."""
    sums = df.groupBy(*fine).agg(*tier_sums(value))
    return attach_group_stats(df, sums.select(*fine, tier_mean(coarse).alias(name)), fine)


def fit_sums(x, y) -> list[Column]:
    """Aggregates of a least-squares line over complete pairs, for ``fit_columns``."""
    a, b = as_col(x), as_col(y)
    paired = F.when(a.isNotNull(), b)
    return [
        F.regr_slope(b, a).alias("__slope"),
        F.coalesce(F.regr_intercept(b, a), F.avg(paired)).alias("__intercept"),
        F.regr_r2(b, a).alias("__r2"),
        F.count(paired).alias("__pairs"),
    ]


def fit_columns() -> list[Column]:
    """Line and goodness of fit.

    A constant x has no slope; its intercept is the mean of y, as for a fit that drops
    the term. Adjusted R2 is null without residual degrees of freedom. Without a pair
    there is no fit.
    """
    n, slope = F.col("__pairs"), F.col("__slope")
    straight, none = slope.isNotNull(), n == 0
    return [
        F.col("__intercept").alias("InterceptEstimate"),
        slope.alias("XEstimate"),
        F.when(none, None)
        .when(straight & (n > 2), 1 - (1 - F.col("__r2")) * (n - 1) / (n - 2))
        .when(~straight, F.lit(0.0))
        .alias("AdjRSquared"),
        F.when(none, None).when(straight, n - 2).otherwise(n - 1).alias("DfResidual"),
    ]


def linear_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group that has a complete pair."""
    fit = df.groupBy(*keys).agg(*fit_sums(x, y)).where(F.col("__pairs") > 0)
    return fit.select(*keys, *fit_columns())


def long_to_wide(
    df: DataFrame, keys: list[str], name: str, value: str, names: list[str]
) -> DataFrame:
    """One column per listed name; running it raises where a name has several values."""
    kind = df.schema[value].dataType
    several = F.raise_error(F.lit(f"several values of one {name}")).cast(kind)
    only = F.when(F.count(value) > 1, several).otherwise(F.max(value))
    return df.groupBy(*keys).pivot(name, names).agg(only)


def box_summary(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Quartiles and whiskers: the extreme values within 1.5 quartile distances."""
    q1, q2, q3 = (quantile_name(column, p) for p in (0.25, 0.5, 0.75))
    q = staged(quartiles(df, keys, [column]))
    v = as_col(column)
    reach = (F.col(q3) - F.col(q1)) * 1.5
    ends = (
        attach(df.select(*keys, v.alias(column)), q, keys, "inner")
        .where((v >= F.col(q1) - reach) & (v <= F.col(q3) + reach))
        .groupBy(*keys)
        .agg(F.min(v).alias("whisker_low"), F.max(v).alias("whisker_high"))
    )
    return attach(q, ends, keys).select(
        *keys,
        F.col(f"{column}_n").alias("n"),
        "whisker_low",
        F.col(q1).alias("q1"),
        F.col(q2).alias("median"),
        F.col(q3).alias("q3"),
        "whisker_high",
    )


def histogram(df: DataFrame, keys: list[str], column: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins between the group's extremes.

    The maximum falls in the last bin; a group of one value has a single bin 1. The values
    are read twice, so they are staged first.
    """
    v = as_col(column).cast("double")
    rows = staged(df.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull()))
    ends = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    lo, hi, x = F.col("__lo"), F.col("__hi"), F.col("__v")
    at = F.floor((x - lo) / (hi - lo) * bins) + 1
    bin_ = F.when(hi == lo, F.lit(1)).otherwise(F.least(at, F.lit(bins)))
    return (
        attach_group_stats(rows, ends, keys)
        .groupBy(*keys, bin_.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def normality_screen(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Count, skewness and excess kurtosis (population moments) per group."""
    v = as_col(column)
    return (
        df.where(v.isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.skewness(v).alias("skewness"),
            F.kurtosis(v).alias("kurtosis"),
        )
    )
