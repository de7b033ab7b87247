"""Collapse and choice among repeated rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stubble.functions.measures import date_of_serial
from stubble.operators.replicates import choose_replicates, duplicate_counts, first_non_null
from stubble.queries.base import query, r, rounded, table


@query(f"""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN value END AS v,
    CASE WHEN event_type <> 'view' THEN event_type END AS k,
    CASE WHEN value > 10 THEN props END AS p FROM events)
SELECT user_id, {r("first(v ORDER BY ts, event_id) FILTER (WHERE v IS NOT NULL)")} AS v,
  first(k ORDER BY ts, event_id) FILTER (WHERE k IS NOT NULL) AS k,
  first(p ORDER BY ts, event_id) FILTER (WHERE p IS NOT NULL) AS p FROM e GROUP BY user_id""")
def first_non_null_collapse(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    rows = table(spark, sf_dir, "events").select(
        "user_id",
        "ts",
        "event_id",
        F.when(kind != "error", value).alias("v"),
        F.when(kind != "view", kind).alias("k"),
        F.when(value > 10, F.col("props")).alias("p"),
    )
    return rounded(first_non_null(rows, ["user_id"], ["ts", "event_id"]))


_ROWS = """x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS part, l_quantity AS mass,
    CASE WHEN l_returnflag = 'A' THEN l_tax + 0.0 END AS protein,
    CAST(datediff('day', DATE '1900-01-01', CAST(l_shipdate AS DATE)) AS INT) AS saved,
    CASE WHEN l_linestatus = 'O' THEN l_discount + 0.0 END AS bag,
    l_extendedprice AS price FROM lineitem)"""
_TIERS = ["protein IS NOT NULL", "saved >= 36524", "bag IS NOT NULL"]


def _tier(i: int, test: str) -> str:
    """Rows of a tier per id: count, distinct rows, distinct masses, first row."""
    return f"""t{i} AS (SELECT id, count(*) AS n, count(DISTINCT (part, mass, protein, saved, bag, price)) AS k,
    count(DISTINCT mass) AS m,
    arg_min((part, mass, price), (saved, price, part, mass, coalesce(protein, -1), coalesce(bag, -1))) AS pick
  FROM x WHERE {test} GROUP BY id)"""


_PASS = "CASE WHEN t{i}.n = 1 OR (t{i}.n > 1 AND ((t{i}.n - t{i}.k) * 2 = t{i}.n OR t{i}.m = 1)) THEN t{i}.pick END"


@query(f"""WITH {_ROWS}, {", ".join(_tier(i, t) for i, t in enumerate(["true", *_TIERS]))},
  c AS (SELECT t0.id, CASE WHEN t0.n = 1 THEN t0.pick ELSE coalesce({", ".join(_PASS.format(i=i) for i in (1, 2, 3))})
    END AS pick FROM t0 LEFT JOIN t1 ON t1.id = t0.id LEFT JOIN t2 ON t2.id = t0.id
    LEFT JOIN t3 ON t3.id = t0.id)
SELECT id, pick[1] AS part, {r("pick[2]")} AS mass, {r("pick[3]")} AS price FROM c WHERE pick IS NOT NULL""")
def priority_replicates(spark, sf_dir):
    """One row per (order, line): lab rows, then late ones, then bagged ones."""
    days = F.date_diff(F.to_date("l_shipdate"), F.lit("1900-01-01").cast("date"))
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").alias("mass"),
        F.when(F.col("l_returnflag") == "A", F.col("l_tax") + F.lit(0.0)).alias("protein"),
        days.alias("saved"),
        F.when(F.col("l_linestatus") == "O", F.col("l_discount") + F.lit(0.0)).alias("bag"),
        F.col("l_extendedprice").alias("price"),
    )
    file_order = {
        "o1": F.col("saved"),
        "o2": F.col("price"),
        "o3": F.col("part"),
        "o4": F.col("mass"),
        "o5": F.coalesce("protein", F.lit(-1.0)),
        "o6": F.coalesce("bag", F.lit(-1.0)),
    }
    tiers = [
        F.col("protein").isNotNull(),
        F.year(date_of_serial("saved")) >= 2000,
        F.col("bag").isNotNull(),
    ]
    chosen = choose_replicates(
        rows.withColumns(file_order), "id", tiers, "mass", list(file_order)
    )
    return rounded(chosen.select("id", "part", "mass", "price"))


@query("""SELECT o_custkey, count(*) AS n_rows,
  count(*) - count(DISTINCT (o_orderstatus, o_orderpriority)) AS n_repeats,
  count(DISTINCT o_orderstatus) AS n_values FROM orders GROUP BY o_custkey""")
def repeat_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return duplicate_counts(rows, ["o_custkey"], "o_orderstatus")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()
