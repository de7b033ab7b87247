"""Outlier and quartile classes of values within their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stubble.functions import as_col
from stubble.operators.joins import attach, attach_group_stats
from stubble.operators.quantiles import quantile_name, quartiles
from stubble.operators.staging import staged

# Multiples of the interquartile range at the inner and outer fence.
INNER = 1.5
OUTER = 3.0


def beyond_fence(value, q1, q3, multiple: float) -> Column:
    """Strictly outside the quartiles widened by a multiple of their distance."""
    v, lo, hi = as_col(value), as_col(q1), as_col(q3)
    reach = (hi - lo) * multiple
    return (v < lo - reach) | (v > hi + reach)


def outlier_class(value, q1, q3) -> Column:
    """0 inside, 1 beyond the inner, 2 beyond the outer fence; null counts as inside."""
    return (
        F.when(beyond_fence(value, q1, q3, OUTER), 2)
        .when(beyond_fence(value, q1, q3, INNER), 1)
        .otherwise(0)
    )


def quartile_class(value, q1, q2, q3) -> Column:
    """1 to 4; on ties the higher rule wins; null stays null."""
    v = as_col(value)
    return (
        F.when(v >= as_col(q3), 4)
        .when(v >= as_col(q2), 3)
        .when(v > as_col(q1), 2)
        .when(v <= as_col(q1), 1)
    )


def with_quartiles(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Attach the exact group quartiles of each column."""
    q = quartiles(df, keys, columns).drop(*[f"{c}_n" for c in columns])
    return attach_group_stats(df, q, keys)


def _quartile_columns(columns: list[str]) -> list[str]:
    return [quantile_name(c, p) for c in columns for p in (0.25, 0.5, 0.75)]


def _q(column: str) -> list[str]:
    return _quartile_columns([column])


def remove_extremes(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Null out values beyond the outer fence of their group."""
    fenced = with_quartiles(df, keys, columns)
    return fenced.withColumns(
        {c: F.when(~beyond_fence(c, _q(c)[0], _q(c)[2], OUTER), as_col(c)) for c in columns}
    ).drop(*_quartile_columns(columns))


def add_outlier_class(
    df: DataFrame, keys: list[str], column: str, name: str = "Outliers"
) -> DataFrame:
    q = _q(column)
    fenced = with_quartiles(df, keys, [column])
    return fenced.withColumn(name, outlier_class(column, q[0], q[2])).drop(*q)


def add_quartile_class(
    df: DataFrame, keys: list[str], column: str, name: str = "Quartiles"
) -> DataFrame:
    q = _q(column)
    return with_quartiles(df, keys, [column]).withColumn(name, quartile_class(column, *q)).drop(*q)


def map_layer(
    df: DataFrame, column: str, keys: list[str], point: list[str], label: str | None = None
) -> DataFrame:
    """Rows behind a map: point, quartile class, outlier class and label.

    Empty when the column holds no value at all.
    """
    q = _q(column)
    found = staged(quartiles(df, keys, [column]).drop(f"{column}_n"))
    layer = attach(df, found, keys).withColumns(
        {"Quartiles": quartile_class(column, *q), "Outliers": outlier_class(column, q[0], q[2])}
    )
    if label is not None:
        layer = layer.withColumn("Label", as_col(label))
    keep = [*point, *keys, column, "Quartiles", "Outliers"] + (["Label"] if label else [])
    layer = layer.select(*keep)
    return layer.where(F.lit(False)) if found.isEmpty() else layer
