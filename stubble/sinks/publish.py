"""Write published tables as CSV folders; nulls are blank cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from stubble.functions import quoted
from stubble.functions.naming import AUDIT, KEY, LEVELS
from stubble.operators.columns import condense, drop_above_level
from stubble.operators.qc import add_qc_summary
from stubble.operators.staging import staged


def write_csv(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """One CSV folder with a header; ``order`` sorts the whole output."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def survey_file_name(
    years: str,
    date: str,
    processing: int | None = None,
    accuracy: int | None = None,
    suffix: str | None = None,
    kind: str = "",
) -> str:
    """``HY{years}_{date}[_P#A#][_{suffix}]{kind}.csv``; the code needs both levels."""
    code = "" if processing is None or accuracy is None else f"_P{processing}A{accuracy}"
    tail = "" if suffix is None else f"_{suffix}"
    return f"HY{years}_{date}{code}{tail}{kind}.csv"


def write_survey(
    df: DataFrame,
    folder: str,
    years: str,
    date: str,
    processing: int | None = None,
    accuracy: int | None = None,
    suffix: str | None = None,
    dictionary: DataFrame | None = None,
    order: list[Column] | None = None,
) -> str:
    """A survey table and, when given, its data dictionary beside it."""
    name = survey_file_name(years, date, processing, accuracy, suffix)
    write_csv(df, f"{folder}/{name}", order)
    if dictionary is not None:
        side = survey_file_name(years, date, processing, accuracy, suffix, "_Dictionary")
        write_csv(dictionary, f"{folder}/{side}")
    return f"{folder}/{name}"


def split_outputs(df: DataFrame, key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(key and audit columns, table without audit and levelled columns)."""
    audit = [c for c in df.columns if c.endswith(tuple(AUDIT))]
    levelled = [c for c in df.columns if c.endswith(tuple(LEVELS))]
    return df.select(*key, *[quoted(c) for c in audit]), df.drop(*audit, *levelled)


def write_three(
    df: DataFrame,
    folder: str,
    name: str,
    processing: int,
    accuracy: int,
    date: str,
    key: list[str] = KEY,
    order: list[Column] | None = None,
    ready: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Comprehensive, audit and clean outputs; returns (audit, clean).

    The table is staged once, so its plan runs once for the three outputs and each
    output reads only its own columns. A table that is ``ready`` is cheap to read again.
    """
    df = df if ready else staged(df)
    code = f"P{processing}A{accuracy}"
    audit, clean = split_outputs(df, key)
    write_csv(df, f"{folder}/{name}_{code}_Comprehensive_{date}.csv", order)
    write_csv(audit, f"{folder}/{name}_{code}_QC_{date}.csv", order)
    write_csv(clean, f"{folder}/{name}_{code}_{date}.csv", order)
    return audit, clean


def level_table(df: DataFrame, processing: int) -> DataFrame:
    """Prune to a level, add the quality summary, condense the levels."""
    return condense(add_qc_summary(drop_above_level(df, processing)), processing)


def publish_level(
    df: DataFrame,
    folder: str,
    name: str,
    processing: int,
    accuracy: int,
    date: str,
    ready: bool = False,
) -> tuple[DataFrame, DataFrame]:
    table = level_table(df, processing)
    return write_three(table, folder, name, processing, accuracy, date, ready=ready)


def described(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Attach (unit, description) to columns as schema metadata."""
    for column, (unit, text) in fields.items():
        df = df.withMetadata(column, {"unit": unit, "description": text})
    return df


# Type names in a data dictionary.
TYPE_NAMES = {
    T.IntegerType(): "Int",
    T.LongType(): "Int",
    T.DoubleType(): "Double",
    T.FloatType(): "Double",
    T.StringType(): "String",
}


def data_dictionary(df: DataFrame) -> DataFrame:
    """FieldName, Units, Description, DataType from the schema and its metadata."""
    rows = [
        (
            f.name,
            f.metadata.get("unit", "unitless"),
            f.metadata.get("description", ""),
            TYPE_NAMES.get(f.dataType, f.dataType.simpleString()),
        )
        for f in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(
        rows, "FieldName string, Units string, Description string, DataType string"
    )


def write_review(df: DataFrame, columns: list[str], path: str, order=None) -> None:
    """Selected columns for a human reviewer."""
    write_csv(df.select(*[quoted(c) for c in columns]), path, order)
