"""Comparisons of two ordered tables by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from stubble.operators.checks import position_differences
from stubble.operators.order import with_file_order
from stubble.queries.base import query, table
from stubble.queries.filing import fresh
from stubble.sinks.publish import write_csv

_SECOND = """SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 WHEN doc_id % 11 <> 0 THEN n_chars END
    AS n_chars FROM documents WHERE doc_id % 500 <> 499"""


@query(f"""WITH a AS (SELECT n_chars, row_number() OVER (ORDER BY source NULLS LAST, doc_id) AS position FROM documents),
b AS (SELECT n_chars, row_number() OVER (ORDER BY source NULLS LAST, doc_id) AS position FROM ({_SECOND}))
SELECT position, CASE WHEN b.position IS NULL THEN 'mine' WHEN a.position IS NULL THEN 'theirs' ELSE 'both' END AS side,
  'n_chars' AS measure, CAST(a.n_chars AS DOUBLE) AS mine, CAST(b.n_chars AS DOUBLE) AS theirs,
  CAST(a.n_chars - b.n_chars AS DOUBLE) AS difference
FROM a FULL JOIN b USING (position) WHERE a.n_chars IS DISTINCT FROM b.n_chars OR a.position IS NULL OR b.position IS NULL""")
def row_aligned_differences(spark, sf_dir):
    """Two files sorted by source, ties in file order, compared row by row.

    The second file lacks some rows, so every later position is shifted.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    size, id = F.col("n_chars"), F.col("doc_id")
    changed = F.when(id % 7 == 0, size + 1).when(id % 11 != 0, size)
    files = []
    for name, rows in (("first", docs), ("second", docs.where(id % 500 != 499).withColumn("n_chars", changed))):
        files.append(fresh(spark, name))
        write_csv(rows, files[-1], [id])
    schema = "doc_id long, source string, n_chars string"
    read = [with_file_order(spark.read.schema(schema).csv(f, header=True)) for f in files]
    places = {"place": "__place", "other_place": "__place"}
    return position_differences(*read, ["source"], {"n_chars": "n_chars"}, **places)
