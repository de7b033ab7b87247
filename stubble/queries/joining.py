"""Joins, unions, grid completion and corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from stubble.functions.measures import differs, label_if_differs, mean_of_present, positive, prefer, within
from stubble.functions.text import paste
from stubble.operators.columns import recode
from stubble.operators.grid import append_missing, complete_grid
from stubble.operators.joins import (
    apply_corrections,
    attach,
    attach_points_full,
    attach_points_inner,
    full_attach,
    label_differences,
    merge_sides,
    tag_in_boundary,
)
from stubble.operators.sets import difference, merge_surveys, union_diagonal
from stubble.operators.staging import staged
from stubble.plans.harvests import all_years
from stubble.plans.review import reconciled
from stubble.queries.base import S, query, r, rounded, samples, table

# Two sources of one measure: order totals and summed line items; sums at or under a
# limit, and priorities that were not specified, stand for what a source does not know.
_SOURCES = """a AS (SELECT o_orderkey AS ID, CAST(year(o_orderdate) AS INT) AS Year,
    o_orderstatus AS Crop,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice END AS TotalA FROM orders),
  b AS (SELECT l_orderkey AS ID,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS TotalB
  FROM lineitem GROUP BY l_orderkey)"""


def source_a(spark, sf_dir):
    known = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID"),
        F.year("o_orderdate").alias("Year"),
        F.col("o_orderstatus").alias("Crop"),
        F.when(known, F.col("o_totalprice")).alias("TotalA"),
    )


def source_b(spark, sf_dir):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("ID"))
        .agg(F.sum(price).cast("double").alias("TotalB"))
    )


_KEPT_A = "CASE WHEN TotalA > 50000 AND TotalA <= 400000 THEN TotalA END"
_KEPT_B = "CASE WHEN TotalB > 50000 AND TotalB <= 400000 THEN TotalB END"


@query(f"""WITH {_SOURCES}, j AS (SELECT a.*, TotalB, {_KEPT_A} AS ka, {_KEPT_B} AS kb
  FROM a LEFT JOIN b ON a.ID = b.ID)
SELECT ID, Year, {r("coalesce(kb, ka)")} AS Preferred,
  {r("CASE WHEN ka IS NOT NULL AND kb IS NOT NULL THEN (ka + kb) / 2 ELSE coalesce(ka, kb) END")}
    AS MeanOfBoth, {r("coalesce(TotalA, TotalB)")} AS FirstKnown FROM j""")
def two_source_reconcile(spark, sf_dir):
    both = attach(source_a(spark, sf_dir), source_b(spark, sf_dir), ["ID"])
    a, b = within("TotalA", 50000, 400000), within("TotalB", 50000, 400000)
    return rounded(
        both.select(
            "ID",
            "Year",
            prefer(b, a).alias("Preferred"),
            mean_of_present(a, b).alias("MeanOfBoth"),
            prefer("TotalA", "TotalB").alias("FirstKnown"),
        )
    )


def _kept(side: str) -> str:
    reach = f"3 * (q3{side} - q1{side})"
    return f"CASE WHEN {side} >= q1{side} - {reach} AND {side} <= q3{side} + {reach} THEN {side} END"


@query(f"""WITH {_SOURCES}, j AS (SELECT a.ID, Year, Crop,
    CASE WHEN TotalA > 0 THEN TotalA * TotalA END AS x,
    CASE WHEN TotalB > 0 THEN TotalB * TotalB END AS y FROM a LEFT JOIN b ON a.ID = b.ID),
  q AS (SELECT Year AS qy, Crop AS qc, quantile_cont(x, 0.25) AS q1x, quantile_cont(x, 0.75) AS q3x,
    quantile_cont(y, 0.25) AS q1y, quantile_cont(y, 0.75) AS q3y FROM j GROUP BY Year, Crop),
  k AS (SELECT ID, Year, Crop, {_kept("x")} AS kx, {_kept("y")} AS ky
    FROM j JOIN q ON qy = Year AND qc = Crop)
SELECT ID, Year, Crop, {r("kx / 1e6")} AS A, {r("ky / 1e6")} AS B,
  {r("CASE WHEN kx IS NOT NULL AND ky IS NOT NULL THEN (kx + ky) / 2 ELSE coalesce(kx, ky) END / 1e6")}
    AS Final FROM k""")
def reconcile_without_extremes(spark, sf_dir):
    a = source_a(spark, sf_dir).withColumn("TotalA", F.col("TotalA") * F.col("TotalA"))
    b = source_b(spark, sf_dir).withColumn("TotalB", F.col("TotalB") * F.col("TotalB"))
    out = reconciled(a, staged(b), ["ID"], ["Year", "Crop"], {"Total": ("TotalA", "TotalB")})
    return rounded(
        out.select(
            "ID",
            "Year",
            "Crop",
            (F.col("TotalAKept") / 1e6).alias("A"),
            (F.col("TotalBKept") / 1e6).alias("B"),
            (F.col("TotalFinal") / 1e6).alias("Final"),
        )
    )


_LABELS = """l AS (SELECT l_orderkey AS ID, CASE WHEN min(l_linestatus) = max(l_linestatus)
  THEN min(l_linestatus) ELSE 'P' END AS other FROM lineitem GROUP BY l_orderkey)"""


@query(f"""WITH {_LABELS} SELECT o_orderkey AS ID, CAST(year(o_orderdate) AS INT) AS Year,
  o_orderstatus AS Label, other AS OtherLabel, true AS Differs, o_orderstatus AS Shown
FROM orders JOIN l ON l.ID = o_orderkey WHERE o_orderstatus <> other""")
def label_mismatches(spark, sf_dir):
    status = F.col("l_linestatus")
    other = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("ID"))
        .agg(
            F.when(F.min(status) == F.max(status), F.min(status)).otherwise("P").alias("OtherLabel")
        )
    )
    own = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID"),
        F.year("o_orderdate").alias("Year"),
        F.col("o_orderstatus").alias("Label"),
    )
    return label_differences(own, other, ["ID"], "Label", "OtherLabel").withColumns(
        {
            "Differs": differs("Label", "OtherLabel"),
            "Shown": label_if_differs("Label", "OtherLabel"),
        }
    )


# Reference points: one per nation, on a grid of nation number and region.
_POINTS = """p AS (SELECT n_nationkey AS "Column", CAST(n_regionkey AS VARCHAR) AS Row2,
  CAST(n_nationkey * 1.5 AS DOUBLE) AS X, CAST(n_regionkey * 2.5 AS DOUBLE) AS Y, n_name AS Place FROM nation)"""


def points(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("Column"),
        F.col("n_regionkey").cast("string").alias("Row2"),
        (F.col("n_nationkey") * 1.5).alias("X"),
        (F.col("n_regionkey") * 2.5).alias("Y"),
        F.col("n_name").alias("Place"),
    )


@query(f"""WITH {_POINTS}, s AS (SELECT c_custkey AS ID, c_nationkey AS "Column",
    CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN '1'
      ELSE '0' END AS Row2 FROM customer)
SELECT coalesce(s."Column", p."Column") AS "Column", coalesce(s.Row2, p.Row2) AS Row2, ID, X, Y, Place
FROM s FULL JOIN p ON s."Column" IS NOT DISTINCT FROM p."Column"
  AND s.Row2 IS NOT DISTINCT FROM p.Row2""")
def georef_attach_full(spark, sf_dir):
    segment = F.col("c_mktsegment")
    placed = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ID"),
        F.col("c_nationkey").alias("Column"),
        F.when(segment == "BUILDING", None)
        .when(segment == "MACHINERY", "1")
        .otherwise("0")
        .alias("Row2"),
    )
    return attach_points_full(placed, points(spark, sf_dir), ["Column", "Row2"])


@query(f"""SELECT event_id, user_id AS ID2, {r("s_acctbal")} AS Longitude,
  {r("s_nationkey * 1.5")} AS Latitude FROM events JOIN supplier ON s_suppkey = user_id""")
def georef_attach_inner(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("ID2"))
    places = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ID2"),
        F.col("s_acctbal").alias("X"),
        (F.col("s_nationkey") * 1.5).alias("Y"),
    )
    return rounded(attach_points_inner(events, places, "ID2"))


@query(f"""WITH g AS (SELECT l_orderkey AS k, sum(l_quantity) AS Grain FROM lineitem
    WHERE l_linestatus = 'F' GROUP BY 1),
  z AS (SELECT l_orderkey AS k, sum(l_quantity) AS Residue FROM lineitem
    WHERE l_linestatus = 'O' GROUP BY 1)
SELECT coalesce(g.k, z.k) AS Barcode, {r("Grain")} AS Grain, {r("Residue")} AS Residue
FROM g FULL JOIN z ON g.k = z.k""")
def full_attach_masses(spark, sf_dir):
    def mass(status, name):
        return (
            table(spark, sf_dir, "lineitem")
            .where(F.col("l_linestatus") == status)
            .groupBy(F.col("l_orderkey").alias("Barcode"))
            .agg(F.sum("l_quantity").alias(name))
        )

    return rounded(full_attach(mass("F", "Grain"), mass("O", "Residue"), ["Barcode"], unique=True))


@query(f"""SELECT o_orderkey AS ID, o_custkey AS Barcode, {r("o_totalprice")} AS Value_x,
  {r("c_acctbal")} AS Value_y, c_mktsegment AS Segment,
  {r("CASE WHEN o_totalprice > 400000 THEN c_acctbal ELSE o_totalprice END")} AS Chosen
FROM orders JOIN customer ON c_custkey = o_custkey""")
def merge_on_barcode(spark, sf_dir):
    sheet = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID"),
        F.col("o_custkey").alias("Barcode"),
        F.col("o_totalprice").alias("Value"),
    )
    lab = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Sample"),
        F.col("c_acctbal").alias("Value"),
        F.col("c_mktsegment").alias("Segment"),
    )
    merged = merge_sides(sheet, lab, "Barcode", "Sample", ("_x", "_y"))
    known = F.when(F.col("Value_x") <= 400000, F.col("Value_x"))
    return rounded(merged.withColumn("Chosen", prefer(known, "Value_y")))


@query(f"""SELECT o_orderkey AS ID, {r("s_acctbal")} AS Balance, s_name AS Name,
  CAST(o_orderdate AS DATE) AS Day FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""")
def lookup_left(spark, sf_dir):
    """Left lookup by one key."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ID"), "o_custkey", F.to_date("o_orderdate").alias("Day")
    )
    lookup = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_acctbal").alias("Balance"), F.col("s_name").alias("Name")
    )
    return rounded(attach(orders, lookup, {"o_custkey": "s_suppkey"}).drop("o_custkey"))


# ---- grid and sets ------------------------------------------------------------------

_SEEN = """seen AS (SELECT DISTINCT CAST(ts AS DATE) AS Day, user_id AS ID2 FROM events)"""
_GAPS = f"""{_SEEN}, base AS (SELECT DISTINCT ID2 FROM seen WHERE Day = DATE '2024-01-01'),
  gaps AS (SELECT Day, ID2 FROM (SELECT DISTINCT Day FROM seen), base EXCEPT SELECT Day, ID2 FROM seen)"""


def sightings(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("Day"), F.col("user_id").alias("ID2")
    )


@query(f"WITH {_GAPS} SELECT Day, ID2 FROM gaps")
def grid_completion(spark, sf_dir):
    return complete_grid(sightings(spark, sf_dir), "Day", "ID2", "2024-01-01")


@query(f"""WITH {_GAPS} SELECT Day, ID2, 1 AS CropExists, CAST(NULL AS DOUBLE) AS Longitude,
  CAST(NULL AS DOUBLE) AS Latitude FROM seen UNION ALL
SELECT Day, ID2, 0, s_acctbal, s_nationkey * 1.5 FROM gaps JOIN supplier ON s_suppkey = ID2""")
def append_missing_points(spark, sf_dir):
    df = sightings(spark, sf_dir).distinct().select(
        "Day",
        "ID2",
        F.lit(1).alias("CropExists"),
        F.lit(None).cast("double").alias("Longitude"),
        F.lit(None).cast("double").alias("Latitude"),
    )
    places = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ID2"),
        F.col("s_acctbal").alias("X"),
        (F.col("s_nationkey") * 1.5).alias("Y"),
        F.col("s_name").alias("Name"),
    )
    return append_missing(df, places, "2024-01-01", year="Day")


@query("""SELECT c_custkey AS ID FROM customer EXCEPT SELECT user_id FROM events""")
def set_difference(spark, sf_dir):
    return difference(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ID")),
        table(spark, sf_dir, "events").select(F.col("user_id").alias("ID")),
        "ID",
    )


@query(f"""SELECT c_custkey AS ID, c_name AS Name, c_mktsegment AS Segment, NULL AS Nation,
  {r("c_acctbal")} AS Balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey, {r("s_acctbal")} FROM supplier
UNION ALL SELECT p_partkey, p_name, p_type, NULL, NULL FROM part""")
def diagonal_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ID"),
        F.col("c_name").alias("Name"),
        F.col("c_mktsegment").alias("Segment"),
        F.col("c_acctbal").alias("Balance"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ID"),
        F.col("s_name").alias("Name"),
        F.col("s_nationkey").alias("Nation"),
        F.col("s_acctbal").alias("Balance"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ID"),
        F.col("p_name").alias("Name"),
        F.col("p_type").alias("Segment"),
    )
    return rounded(union_diagonal(customers, suppliers, parts))


@query(f"""SELECT CAST(year(o_orderdate) AS INT) AS HarvestYear, o_orderkey AS ID2,
  {r("o_totalprice")} AS Yield, NULL AS Residue FROM orders
UNION ALL SELECT HarvestYear, ID2, {r("y")}, {r("b - y")} FROM (
  SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS HarvestYear, l_orderkey AS ID2,
    l_quantity AS y, l_extendedprice AS b FROM lineitem WHERE l_returnflag = 'A')""")
def later_survey_union(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("HarvestYear"),
        F.col("o_orderkey").alias("ID2"),
        F.col("o_totalprice").alias("Yield"),
    )
    later = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("FieldId"),
        F.year("l_shipdate").alias("HarvestYear"),
        F.col("l_orderkey").alias("ID2"),
        F.col("l_quantity").alias("Grain"),
        F.col("l_extendedprice").alias("Biomass"),
    )
    return rounded(
        merge_surveys(
            own,
            later,
            "FieldId",
            "A",
            {"Rest": F.col("Biomass") - F.col("Grain")},
            {"HarvestYear": "HarvestYear", "ID2": "ID2", "Grain": "Yield", "Rest": "Residue"},
        )
    )


@query(f"""WITH {S} SELECT HarvestYear, ID2, Crop, {r("GrainMassWet")} AS GrainMassWet,
  NULL AS BiomassWet FROM s WHERE HarvestYear < 1998
UNION ALL SELECT HarvestYear, ID2, Crop, NULL, {r("BiomassWet")} FROM s WHERE HarvestYear >= 1998""")
def all_years_union(spark, sf_dir):
    s = samples(spark, sf_dir)
    early = s.where("HarvestYear < 1998").select("HarvestYear", "ID2", "Crop", "GrainMassWet")
    late = s.where("HarvestYear >= 1998").select("HarvestYear", "ID2", "Crop", "BiomassWet")
    return rounded(all_years(early, late))


# ---- corrections and codes ----------------------------------------------------------

_CODES = {"ECONOMY": "EC", "SMALL": "SM", "PROMO": "PR", "red widget": "RW", "Brand#1": "B1"}


@query(
    "SELECT p_partkey, "
    + ", ".join(
        "CASE "
        + " ".join(f"WHEN {c} = '{a}' THEN '{b}'" for a, b in _CODES.items())
        + f" ELSE {c} END AS {c}"
        for c in ("p_name", "p_brand", "p_type")
    )
    + " FROM part"
)
def recode_values(spark, sf_dir):
    return recode(
        table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), _CODES
    )


@query(f"""SELECT p_partkey, CASE WHEN s_suppkey IS NULL THEN {r("p_retailprice")}
    WHEN s_acctbal > 5000 THEN {r("s_acctbal")} END AS price,
  CASE WHEN s_suppkey IS NULL OR s_nationkey < 10 THEN p_size ELSE s_nationkey END AS size
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def keyed_corrections(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    balance = F.col("s_acctbal")
    fixes = supplier.select(
        F.col("s_suppkey").alias("p_partkey"),
        F.lit("price").alias("Variable"),
        F.when(balance > 5000, balance).alias("NewVal"),
    ).unionByName(
        supplier.where("s_nationkey >= 10").select(
            F.col("s_suppkey").alias("p_partkey"),
            F.lit("size").alias("Variable"),
            F.col("s_nationkey").cast("double").alias("NewVal"),
        )
    )
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")
    )
    return rounded(apply_corrections(parts, fixes, ["p_partkey"], ["price", "size"]))


# ---- boundary ------------------------------------------------------------------------

RING = [(-0.2, -0.2), (0.05, -0.25), (0.2, -0.05), (0.02, 0.0), (0.15, 0.2), (-0.1, 0.22), (-0.2, -0.2)]


def _crossings() -> str:
    terms = [
        f"CASE WHEN ({y1} > py) <> ({y2} > py) AND px < ({x2} - {x1}) * (py - {y1}) / ({y2} - {y1}) + {x1}"
        " THEN 1 ELSE 0 END"
        for (x1, y1), (x2, y2) in (
            (tuple(f"CAST({v} AS DOUBLE)" for v in a), tuple(f"CAST({v} AS DOUBLE)" for v in b))
            for a, b in zip(RING, RING[1:])
            if a[1] != b[1]
        )
    ]
    return reduce(lambda a, b: f"{a} + {b}", terms)


@query(f"""WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS px,
    CAST(embedding[2] AS DOUBLE) AS py FROM embeddings)
SELECT vec_id, {r("px")} AS px, {r("py")} AS py, ({_crossings()}) % 2 = 1 AS InBoundary,
  coalesce(CAST(label AS VARCHAR), 'NA') || '-' || CAST(vec_id AS VARCHAR) AS FieldStrip FROM p""")
def point_in_polygon(spark, sf_dir):
    pts = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.col("embedding")[0].cast("double").alias("px"),
        F.col("embedding")[1].cast("double").alias("py"),
    )
    tagged = tag_in_boundary(pts, "px", "py", RING)
    return rounded(tagged.withColumn("FieldStrip", paste("label", "vec_id", sep="-")).drop("label"))


@query(f"""SELECT o_orderkey AS ID, {r("o_totalprice")} AS Price, o_orderstatus AS Status
FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O')
  AND nullif(o_orderpriority, '4-NOT SPECIFIED') <> '5-LOW' AND o_totalprice > 0
  AND year(o_orderdate) IN (1996, 1998)""")
def filtered_samples(spark, sf_dir):
    """Equality, inequality (drops nulls), membership and positive-value predicates."""
    crop = F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))
    status = F.col("o_orderstatus")
    return rounded(
        table(spark, sf_dir, "orders")
        .where((status == "F") | (status == "O"))
        .where(crop != "5-LOW")
        .where(F.year("o_orderdate").isin(1996, 1998))
        .select(
            F.col("o_orderkey").alias("ID"),
            positive("o_totalprice").alias("Price"),
            status.alias("Status"),
        )
        .where(F.col("Price").isNotNull())
    )
