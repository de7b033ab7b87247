"""Lab sheets staged as delimited text files, one record per line.

A sheet has title rows above its header, sometimes several blocks of rows with their own
columns, and no schema. Lines are numbered per file without gathering a file: every file
block counts its own lines, and the running total of the earlier blocks is added.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stubble.functions.measures import date_of_serial
from stubble.functions.text import null_tokens
from stubble.operators.joins import attach
from stubble.operators.sets import union_diagonal
from stubble.operators.staging import staged

# Cell texts that mean "no value" in lab sheets.
MISSING = ["-99999", "-77777", "na", "NA", "N/A"]


@dataclass(frozen=True)
class Sheet:
    """Where the rows of a sheet are and what their cells mean.

    ``header`` is the 1-based line of the column names; without it ``names`` are given.
    ``types`` are read by position: a Spark type or ``skip``; missing ones are text.
    """

    header: int | None = 1
    first: int | None = None
    last: int | None = None
    names: list[str] | None = None
    types: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=lambda: list(MISSING))
    separator: str = ","
    label: tuple[str, str] | None = None  # (column, pattern with one group on the file name)


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """``path, name, line, value`` for every line of every file.

    How files are split depends on the cluster at that moment, so the files are read once
    into a staged table, and offsets and lines are both made from that.
    """
    raw = staged(
        spark.read.text(paths).select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("name"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    blocks = raw.groupBy("path", "block").agg(
        F.min("at").alias("__start"), F.count("*").alias("__lines")
    )
    earlier = (
        Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = blocks.select(
        "path",
        "block",
        "__start",
        F.coalesce(F.sum("__lines").over(earlier), F.lit(0)).alias("__before"),
    )
    return attach(raw, staged(offsets), ["path", "block"], "inner", null_safe=False).select(
        "path",
        "name",
        (F.col("at") - F.col("__start") + F.col("__before") + 1).alias("line"),
        "value",
    )


def read_sheet(spark: SparkSession, paths, sheet: Sheet) -> DataFrame:
    """The rows of a sheet (or of many files laid out alike) as typed columns."""
    lines = numbered_lines(spark, paths)
    names = sheet.names or _header(lines, sheet)
    first = sheet.first or ((sheet.header or 0) + 1)
    rows = lines.where(F.col("line") >= first)
    if sheet.last is not None:
        rows = rows.where(F.col("line") <= sheet.last)
    rows = rows.where(F.regexp_replace("value", f"[\\s{_escaped(sheet.separator)}]", "") != "")
    width = max(len(sheet.types), len(names))
    cells = F.from_csv(
        "value",
        F.lit(", ".join(f"c{i} string" for i in range(width))),
        {"sep": sheet.separator, "escape": '"', "mode": "PERMISSIVE"},
    )
    kept = [i for i in range(width) if not (i < len(sheet.types) and sheet.types[i] == "skip")]
    labels = names if len(names) == len(kept) else [names[i] for i in kept]
    out = []
    for i, name in zip(kept, labels):
        cell = null_tokens(F.col("cells")[f"c{i}"], sheet.missing)
        kind = sheet.types[i] if i < len(sheet.types) else "string"
        out.append((cell if kind == "string" else F.trim(cell).try_cast(kind)).alias(name))
    parsed = rows.withColumn("cells", cells)
    if sheet.label is not None:
        column, pattern = sheet.label
        out.insert(0, F.regexp_extract("name", pattern, 1).try_cast("int").alias(column))
    return parsed.select(*out)


def _header(lines: DataFrame, sheet: Sheet) -> list[str]:
    """Column names from the header line; repeated names get their position.

    Files that are read together must have one header.
    """
    found = lines.where(F.col("line") == sheet.header).select("value").distinct().collect()
    if not found:
        raise ValueError(f"no header in line {sheet.header}")
    read = [next(csv.reader([r["value"]], delimiter=sheet.separator), []) for r in found]
    headers = [[c.strip().lstrip("﻿") for c in cells] for cells in read]
    cells = headers[0]
    if any(other != cells for other in headers[1:]):
        raise ValueError(f"files with different headers: {headers[:2]}")
    return [
        c if c and cells.count(c) == 1 else f"{c}...{i}" for i, c in enumerate(cells, start=1)
    ]


def _escaped(separator: str) -> str:
    return {"\t": "\\t", "|": "\\|"}.get(separator, separator)


def read_sheets(spark: SparkSession, sources: list[tuple[object, Sheet]]) -> DataFrame:
    """Several sheets with their own layouts, put together by column name."""
    return union_diagonal(*[read_sheet(spark, paths, sheet) for paths, sheet in sources])


# -- sheets of many layouts in one scan --------------------------------------------------

#: One row per sheet: the key of its files, where its rows are, and what its cells mean.
#: ``places`` names a column and its position (from 1), ``titles`` a column and the text of
#: its header (a repeated one with its position, as in ``read_sheet``); ``kinds`` says how a
#: sheet's numbers and dates are read: ``int`` takes whole numbers alone, ``string`` none, and
#: ``serial`` reads dates from day numbers.
LAYOUT = (
    "sheet string, header int, first int, last int, separator string, missing array<string>, "
    "places map<string,int>, titles map<string,string>, kinds map<string,string>"
)
#: Separators that one catalogue can hold.
SEPARATORS = 8


def _split(value: str, separators: list[str], width: int) -> Column:
    """The cells of a line by the separator of its sheet."""
    schema = F.lit(", ".join(f"c{i} string" for i in range(width)))
    cells = F.lit(None).cast("array<string>")
    for s in separators:
        row = F.from_csv(value, schema, {"sep": s, "escape": '"', "mode": "PERMISSIVE"})
        parts = F.transform(F.array(row), lambda r: F.array(*[r[f"c{i}"] for i in range(width)]))
        cells = F.when(F.col("separator") == s, F.get(parts, F.lit(0))).otherwise(cells)
    return cells


def _titles(lines: DataFrame, separators: list[str], width: int) -> DataFrame:
    """Per file the position of every header text; repeated texts get their position."""
    heads = lines.where("line = header").withColumn("cells", _split("value", separators, width))
    cells = heads.select("path", F.posexplode("cells").alias("at", "text")).where("text IS NOT NULL")
    clean = F.regexp_replace(F.trim("text"), "^\ufeff", "")
    named = cells.select("path", (F.col("at") + 1).alias("at"), clean.alias("text"))
    times = F.count(F.lit(1)).over(Window.partitionBy("path", "text"))
    alone = (F.col("text") != "") & (times == 1)
    title = F.when(alone, F.col("text")).otherwise(F.concat("text", F.lit("..."), F.col("at").cast("string")))
    return (
        named.withColumn("title", title)
        .groupBy("path")
        .agg(F.map_from_entries(F.collect_list(F.struct("title", "at"))).alias("found"))
    )


def read_catalogue(
    spark: SparkSession,
    paths,
    catalogue: DataFrame,
    columns: dict[str, str],
    key: str,
    label: str | None = None,
    width: int = 64,
) -> DataFrame:
    """All sheets of a catalogue in one scan, as rows with ``columns`` (name and type).

    ``catalogue`` has the columns of ``LAYOUT``; the first group of ``key``, matched against a
    file's path, says which of its sheets a file holds. ``label`` names a column that gets
    that key as a number, such as the year of a yearly sheet. A column without a place in a
    sheet is null there. Raises on a file that no sheet is for, on two sheets of one key, and
    on a title that a file's header does not have.

    The layouts are a table joined to the lines, so their number changes neither the plan nor
    the number of scans; only the separators, ``SEPARATORS`` at most, are part of the plan.
    """
    sheets = staged(catalogue.select(*StructType.fromDDL(LAYOUT).names))
    twice = sheets.groupBy("sheet").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"more than one layout for {[r[0] for r in twice]}")
    separators = sorted(r[0] for r in sheets.select("separator").distinct().limit(SEPARATORS + 1).collect())
    if len(separators) > SEPARATORS:
        raise ValueError(f"more than {SEPARATORS} separators in one catalogue")
    plain = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    lines = numbered_lines(spark, paths).withColumn("sheet", F.regexp_extract(plain, key, 1))
    known = attach(lines, sheets.withColumn("listed", F.lit(True)), ["sheet"], null_safe=False)
    strange = known.where("listed IS NULL").select("path").distinct().limit(5).collect()
    if strange:
        raise ValueError(f"files without a layout: {[r[0] for r in strange]}")
    titles = staged(_titles(known, separators, width))
    lacking = (
        titles.join(known.where("line = header").select("path", "titles"), "path")
        .select("path", F.explode(F.array_except(F.map_values("titles"), F.map_keys("found"))).alias("title"))
        .limit(5)
        .collect()
    )
    if lacking:
        raise ValueError(f"titles that no header has: {[tuple(r) for r in lacking]}")
    first = F.coalesce("first", F.coalesce("header", F.lit(0)) + 1)
    inside = (F.col("line") >= first) & F.coalesce(F.col("line") <= F.col("last"), F.lit(True))
    filled = F.replace(F.regexp_replace("value", r"\s", ""), "separator", F.lit("")) != ""
    rows = attach(known.where(inside & filled), titles, ["path"]).withColumn("cells", _split("value", separators, width))
    out = [_typed(name, kind).alias(name) for name, kind in columns.items()]
    if label is not None:
        out.insert(0, F.col("sheet").try_cast("int").alias(label))
    return rows.select(*out)


def _typed(name: str, kind: str) -> Column:
    """A column's cell in this sheet, without sentinels, read as the sheet says."""
    column = F.lit(name)
    place = F.coalesce(F.col("places")[column], F.col("found")[F.col("titles")[column]])
    cell = F.get("cells", place - 1)
    text = F.trim(cell)
    missing = F.array_contains(F.coalesce("missing", F.array().cast("array<string>")), text) | (text == "")
    value = F.when(~missing, cell)
    if kind == "string":
        return value
    read, number = F.col("kinds")[column], F.trim(value)
    if kind == "date":
        day = date_of_serial(number.try_cast("double"))
        return F.when(read == "serial", day).otherwise(number.try_cast("date"))
    whole = number.try_cast("bigint").cast(kind)
    return F.when(read == "int", whole).when(F.coalesce(read, F.lit(kind)) != "string", number.try_cast(kind))
