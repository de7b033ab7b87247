"""Published levels that a reader sees whole or not at all.

One scan writes the three files of a level: every row becomes three CSV lines, and the lines
are written to a folder per kind. A publication has a folder of its own, which nothing names
until a line of the level's manifest does. That line is appended when all files are
written, so a failed publication leaves the former one as it was, and whoever reads by the
manifest never sees parts of two.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stubble.functions import quoted
from stubble.functions.naming import KEY
from stubble.sinks.publish import level_table, split_outputs

KINDS = ["Comprehensive", "QC", "Clean"]
_MANIFEST = "name string, code string, date string, number long, version string, rows long, schemas array<string>"
# Nulls are blank cells, and a quote in a cell is written twice.
_LINE = {"escape": '"', "emptyValue": "", "nullValue": ""}


def _line(cells: list[Column]) -> Column:
    return F.to_csv(F.struct(*cells), _LINE)


def _lines(df: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """``kind, value``: every row as one line per kind, and the headers at the top of each task."""
    # A row's number within its task begins at 0: that row brings the headers along.
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    top = F.col("__row").bitwiseAND((1 << 33) - 1) == 0

    def line(kind: str, part: DataFrame) -> Column:
        row = F.struct(F.lit(kind).alias("kind"), F.lit(1).alias("at"), _line([F.col(quoted(c)) for c in part.columns]).alias("value"))
        names = [F.lit(c).alias(f"c{i}") for i, c in enumerate(part.columns)]
        head = F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("at"), _line(names).alias("value"))
        return F.when(top, F.array(head, row)).otherwise(F.array(row))

    every = F.concat(*[line(kind, part) for kind, part in parts.items()])
    lines = numbered.select("__row", F.inline(every))
    # Tasks write one kind after the other; within a file the lines keep the order of the rows.
    return lines.sortWithinPartitions("kind", "at", "__row").select("kind", "value")


def publish_version(
    df: DataFrame, folder: str, name: str, processing: int, accuracy: int, date: str, key: list[str] = KEY
) -> int:
    """Write the three files of a level in one scan, then make them the level's current ones.

    Returns the number of rows.
    """
    code = f"P{processing}A{accuracy}"
    audit, clean = split_outputs(df, key)
    version = f"{name}_{code}_{date}/{uuid.uuid4().hex}"
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    parts = dict(zip(KINDS, (df, audit, clean)))
    _lines(counted, parts).write.partitionBy("kind").text(f"{folder}/{version}")
    rows = seen.get["rows"]
    schemas = [p.schema.json() for p in parts.values()]
    former = current(df.sparkSession, folder, name, code)
    number = 1 + (former["number"] if former else 0)
    line = [(name, code, date, number, version, rows, schemas)]
    df.sparkSession.createDataFrame(line, _MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return rows


def publish_whole_level(df: DataFrame, folder: str, name: str, processing: int, accuracy: int, date: str) -> int:
    """``publish.publish_level`` in one scan and at one moment; returns the number of rows."""
    return publish_version(level_table(df, processing), folder, name, processing, accuracy, date)


def publications(spark: SparkSession, folder: str) -> DataFrame:
    """All publications of a folder; without a manifest there are none."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{folder}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def current(spark: SparkSession, folder: str, name: str, code: str) -> Row | None:
    """The last line of a level in the manifest."""
    mine = publications(spark, folder).where((F.col("name") == name) & (F.col("code") == code))
    return mine.orderBy(F.desc("number"), F.desc("version")).first()


def read_level(
    spark: SparkSession, folder: str, name: str, processing: int, accuracy: int, kind: str = "Clean"
) -> DataFrame:
    """One of the three files of a level, as it was last published in whole."""
    found = current(spark, folder, name, f"P{processing}A{accuracy}")
    if found is None:
        raise ValueError(f"{name} P{processing}A{accuracy} is not published in {folder}")
    schema = StructType.fromJson(json.loads(found["schemas"][KINDS.index(kind)]))
    if not found["rows"]:
        return spark.createDataFrame([], schema)
    path = f"{folder}/{found['version']}/kind={kind}"
    # A cell may hold a line break, so a file is read in one piece.
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)
