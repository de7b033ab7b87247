"""Accuracy level 4: bounds that come from the data, checked and audited like given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stubble.functions import as_col
from stubble.functions.bits import OUTLIER, append_phrase, fence_phrase, previous_value_phrase
from stubble.functions.naming import audit_names
from stubble.operators.joins import attach
from stubble.operators.outliers import OUTER
from stubble.operators.qc import checked
from stubble.operators.quantiles import quantile_name, quartiles
from stubble.operators.staging import staged


def fence_rules(df: DataFrame, keys: list[str], columns: list[str], multiple: float = OUTER) -> DataFrame:
    """``FieldName, Lower, Upper`` per group: the exact quartiles widened by their distance.

    The table has the form of a rule file, so it can be published, read and edited as one.
    """
    found = quartiles(df, keys, columns)

    def rule(c: str) -> Column:
        q1, q3 = (F.col(f"`{quantile_name(c, p)}`") for p in (0.25, 0.75))
        reach = (q3 - q1) * multiple
        return F.struct(F.lit(c).alias("FieldName"), (q1 - reach).alias("Lower"), (q3 + reach).alias("Upper"))

    rules = found.select(*keys, F.inline(F.array(*map(rule, columns))))
    return staged(rules.where("Lower IS NOT NULL AND Upper IS NOT NULL"))


def fence_check(df: DataFrame, rules: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Test columns against the fences of their group and write the outcome in the audit triplets.

    A null key is a group like any other; a group without a rule keeps its rows unchecked.
    """
    bound = F.struct(
        F.col("Lower").cast("double").alias("lo"),
        F.col("Upper").cast("double").alias("hi"),
        fence_phrase("FieldName", "Lower", "Upper").alias("reason"),
    )
    wide = rules.groupBy(*keys).agg(
        *[F.max(F.when(F.col("FieldName") == c, bound)).alias(f"__rule_{i}") for i, c in enumerate(columns)]
    )
    return checked(attach(df, staged(wide), keys), columns, [as_col(c) for c in columns], OUTLIER)


def empty_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Empty the values that failed the fence check, and keep them in the reason."""
    out = {}
    for c in columns:
        _, result, phrase = audit_names(c)
        failed = F.substring(as_col(result), OUTLIER.index("1") + 1, 1) == "1"
        out[c] = F.when(F.coalesce(~failed, F.lit(True)), as_col(c))
        former = F.when(failed, previous_value_phrase(c, F.lit("outlier")))
        out[phrase] = append_phrase(phrase, former)
    return df.withColumns(out)


def outliers_removed(
    df: DataFrame, keys: list[str], columns: list[str], multiple: float = OUTER
) -> tuple[DataFrame, DataFrame]:
    """The level without outliers (P2A4 of a calculated one), and the rules it was made with."""
    rules = fence_rules(df, keys, columns, multiple)
    return empty_outliers(fence_check(df, rules, keys, columns), columns), rules
