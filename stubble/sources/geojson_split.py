"""Large GeoJSON documents read by many tasks.

A document is read as pieces that end at ``}``, so any number of tasks can share one file.
Which of those braces are structure and which are text follows from running sums over the
pieces, first of quotes (is a piece's beginning inside a string?), then of braces outside
strings (how deep is it?). Sums are made block by block, and a block adds the totals of the
blocks before it, so no task sees more than a block of pieces. A feature is the pieces from
the brace that opens depth 2 to the one that closes it; only a feature's own pieces meet.

A document is a file, or a folder whose files, in the order of their names, are the parts of
one document, as Spark writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stubble.operators.joins import attach
from stubble.operators.staging import staged
from stubble.sources.geojson import point_columns, ring_columns

_BLOCK = ["document", "name", "block"]


def _pieces(spark: SparkSession, paths, folder: bool) -> DataFrame:
    """The pieces with their place: document, file, block of the file, number in it.

    How files are split depends on the cluster at the moment of reading, so places are staged
    with the pieces. Every piece ends with its brace but for the rest behind a file's last
    one, which the file's size tells apart (it may also hold a byte order mark, three bytes
    that are not read).
    """
    path = F.col("_metadata.file_path")
    read = staged(
        spark.read.option("lineSep", "}")
        .text(paths)
        .select(
            "value",
            (F.regexp_replace(path, "/[^/]*$", "") if folder else path).alias("document"),
            F.col("_metadata.file_name").alias("name"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    file = ["document", "name"]
    ends = read.groupBy(*file, "size").agg(
        F.sum(F.octet_length("value") + 1).alias("bytes"), F.max(F.struct("block", "at")).alias("end")
    )
    rests = ends.where((F.col("size") - F.col("bytes")).isin(-1, 2))
    ended = attach(read.drop("size"), staged(rests.select(*file, "end")), file, null_safe=False)
    rest = F.coalesce(F.struct("block", "at") == F.col("end"), F.lit(False))
    piece = F.when(rest, F.col("value")).otherwise(F.concat("value", F.lit("}")))
    return ended.withColumn("piece", piece).drop("value", "end")


def _running(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``sums`` of everything before a row in its document, as columns of their names.

    A block's rows are added up in order; of the other blocks only the totals are needed.
    """
    within = Window.partitionBy(*_BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("document").orderBy("name", "block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*_BLOCK).agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = totals.select(
        *_BLOCK, *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums]
    )
    placed = attach(df, staged(before), _BLOCK, "inner", null_safe=False)
    added = {n: F.col(f"__{n}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}
    return placed.withColumns(added).drop(*[f"__{n}" for n in sums])


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char)))).cast("long")


def _outside(inside: Column) -> Column:
    """The piece with every character of its strings made ``_``; its length stays.

    Escapes are pairs of characters within strings and never lie across a piece's end.
    """
    plain = F.regexp_replace("piece", r"(?s)\\.", "__")
    blank = lambda s: F.repeat(F.lit("_"), F.length(s))
    odd = F.when(inside, F.lit(1)).otherwise(F.lit(0))
    parts = F.transform(F.split(plain, '"'), lambda s, i: F.when((i + odd) % 2 == 1, blank(s)).otherwise(s))
    return F.array_join(parts, '"')


def read_feature_texts(spark: SparkSession, paths, folder: bool = False) -> DataFrame:
    """``document, feature, text``: every object at depth 2 of the documents, numbered from 1.

    Besides features these are other objects the document's object holds, such as ``crs``.
    """
    quotes = F.col("n_quotes")
    pieces = _pieces(spark, paths, folder).withColumn(
        "n_quotes", _count(F.regexp_replace("piece", r"(?s)\\.", "__"), '"')
    )
    quoted = _running(pieces, {"quotes": quotes}).withColumn("outside", _outside(F.col("quotes") % 2 == 1))
    braces = staged(
        quoted.withColumns(
            {"opened": _count(F.col("outside"), "{"), "closed": F.when(F.endswith("outside", F.lit("}")), 1).otherwise(0)}
        ).drop("n_quotes", "quotes")
    )
    depth = _running(braces, {"depth": F.col("opened") - F.col("closed")})
    # A piece closes nothing before its end, so it opens depth 2 at most once.
    starts = (F.col("depth") < 2) & (F.col("depth") + F.col("opened") >= 2)
    started = staged(depth.withColumn("starts", F.when(starts, 1).otherwise(0)).drop("closed"))
    numbered = _running(started, {"before": F.col("starts")}).withColumn("feature", F.col("before") + F.col("starts"))
    inner = numbered.where("depth >= 2 OR starts = 1")
    # The object begins at its first brace outside strings, or at the second of a whole document.
    lead = F.when(F.col("depth") == 1, F.substring_index("outside", "{", 1)).otherwise(F.substring_index("outside", "{", 2))
    begun = F.substr("piece", F.length(lead) + 1)
    text = F.when(F.col("starts") == 1, begun).otherwise(F.col("piece"))
    rows = F.sort_array(F.collect_list(F.struct("name", "block", "at", text.alias("text"))))
    return (
        inner.groupBy("document", "feature")
        .agg(rows.alias("pieces"))
        .select("document", "feature", F.array_join(F.col("pieces.text"), "").alias("text"))
    )


def read_features(spark: SparkSession, paths, schema: str, folder: bool = False) -> DataFrame:
    """``f``: the features of the documents, parsed by ``schema`` of one feature."""
    kind = "type: string, " + schema
    found = read_feature_texts(spark, paths, folder)
    return found.select(F.from_json("text", f"struct<{kind}>").alias("f")).where("f.type = 'Feature'")


def read_points(
    spark: SparkSession, paths, properties: dict[str, str], dropped: tuple = ("Strip", "Field"), folder: bool = False
) -> DataFrame:
    """Point features as rows: X, Y and typed properties; equal to ``geojson.read_points``."""
    schema, columns = point_columns(properties, dropped)
    return read_features(spark, paths, schema, folder).select(*columns)


def read_rings(spark: SparkSession, paths, folder: bool = False) -> DataFrame:
    """Polygon features as rows: Id and the outer ring; equal to ``geojson.read_rings``."""
    schema, columns = ring_columns()
    return read_features(spark, paths, schema, folder).select(*columns)
