"""Codes, notes, text in number cells and serial dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stubble.functions.measures import date_of_serial, sample_id, year_of_serial, zero_to_null
from stubble.functions.text import (
    append_notes,
    concat_or_null,
    note_in,
    null_tokens,
    number_in,
    paste,
    remove_first,
    replace_first,
    short_year,
    split_pieces,
    upper_code,
)
from stubble.operators.columns import rename_by_pattern, select_positions, strip_suffixes
from stubble.queries.base import query, r, rounded, table


@query(f"""WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'bad reading'
    WHEN 'view' THEN 'NA' WHEN 'click' THEN '-99999' ELSE json_extract_string(props, '$.k') END AS raw,
    CASE WHEN value > 10 THEN 'high' END AS remark FROM events),
  c AS (SELECT *, CASE WHEN raw NOT IN ('NA', '-99999') THEN raw END AS cell FROM e)
SELECT event_id, {r("try_cast(cell AS DOUBLE)")} AS value,
  CASE WHEN cell IS NOT NULL AND try_cast(cell AS DOUBLE) IS NULL THEN 'Value note: ' || cell || ' '
    ELSE '' END || coalesce('Sample note: ' || remark, '') AS Comments FROM c""")
def text_number_split(spark, sf_dir):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "error", "bad reading")
        .when(kind == "view", "NA")
        .when(kind == "click", "-99999")
        .otherwise(F.get_json_object("props", "$.k"))
    )
    cell = null_tokens(F.col("raw"), ["NA", "-99999"])
    rows = table(spark, sf_dir, "events").select(
        "event_id", raw.alias("raw"), F.when(F.col("value") > 10, "high").alias("remark")
    )
    return rounded(
        rows.select(
            "event_id",
            number_in(cell).alias("value"),
            append_notes(
                ("Value note", note_in(cell), " "), ("Sample note", F.col("remark"), "")
            ).alias("Comments"),
        )
    )


@query("""SELECT s_suppkey, split_part(s_name, '#', 1) AS prefix, split_part(s_name, '#', 2) AS code,
  CAST(NULL AS VARCHAR) AS missing, upper(s_name) AS upper_name,
  substr(s_name, 1, strpos(s_name, '0') - 1) || substr(s_name, strpos(s_name, '0') + 1) AS one_zero_less,
  replace(s_name, 'Supplier#', 'S-') AS renamed,
  CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE 'NA' END || '-' || CAST(s_suppkey AS VARCHAR) AS pasted,
  CASE WHEN s_acctbal > 5000 THEN 'rich_' || CAST(s_suppkey AS VARCHAR) END AS joined FROM supplier""")
def code_split_paste(spark, sf_dir):
    pieces = split_pieces("s_name", "#", ["prefix", "code", "missing"])
    tag = F.when(F.col("s_acctbal") > 5000, "rich")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        *[e.alias(n) for n, e in pieces.items()],
        upper_code("s_name").alias("upper_name"),
        remove_first("s_name", "0").alias("one_zero_less"),
        replace_first("s_name", "Supplier#", "S-").alias("renamed"),
        paste(tag, "s_suppkey", sep="-").alias("pasted"),
        concat_or_null(tag, "s_suppkey").alias("joined"),
    )


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1998
    THEN CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR)
    ELSE nullif(o_orderpriority, '4-NOT SPECIFIED') END AS SampleID,
  substr(CAST(year(o_orderdate) AS VARCHAR), 3, 2) AS yy,
  CAST(o_orderdate AS DATE) AS saved_on, CAST(year(o_orderdate) AS INT) AS saved_year FROM orders""")
def sample_ids_and_dates(spark, sf_dir):
    serial = F.date_diff(F.to_date("o_orderdate"), F.lit("1900-01-01").cast("date"))
    year = F.year("o_orderdate")
    given = F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        sample_id(year, "o_orderkey", given, 1998).alias("SampleID"),
        short_year(year).alias("yy"),
        date_of_serial(serial).alias("saved_on"),
        year_of_serial(serial).alias("saved_year"),
    )


@query(f"""SELECT l_orderkey AS "Order", l_linenumber AS Line, {r("nullif(l_tax, 0)")} AS Tax,
  {r("nullif(l_discount, 0)")} AS discount, l_linestatus AS mode FROM lineitem""")
def names_and_zeros(spark, sf_dir):
    """Columns chosen by position, renamed by part of their name and without a suffix."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax", "l_discount", "l_linestatus"
    )
    chosen = select_positions(
        lines, {1: "Order", 2: "Line", 3: "rate (%T)", 4: "discount_P1", 5: "mode_P2"}
    )
    named = rename_by_pattern(chosen, {"%T": "Tax"})
    plain = dict(zip(named.columns, strip_suffixes(named.columns, ["_P1", "_P2"])))
    zeros = {c: zero_to_null(c) for c in ("Tax", "discount")}
    return rounded(named.withColumnsRenamed(plain).withColumns(zeros))
