"""Points and boundaries: many rings at once, and GeoJSON documents read by many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stubble.operators.spatial import points_in_rings, ring_index, tag_in_rings
from stubble.queries.base import query, rounded, table
from stubble.queries.filing import fresh
from stubble.sinks.geojson import write_point_features, write_ring_features
from stubble.sources.geojson_split import read_points, read_rings

# Plots stand 64 in a row; the corners of a plot's star, and of the strip along a row.
_WIDE = 64
_STAR = [(1.25, 0.0), (0.375, 0.375), (0.0, 1.25), (-0.375, 0.375), (-1.25, 0.0), (-0.375, -0.375), (0.0, -1.25), (0.375, -0.375)]
_STRIP = [(-2.0, -0.25), (66.0, -0.25), (66.0, 0.25), (-2.0, 0.25)]


def field_points(spark, sf_dir):
    """Vectors as points: a plot by their number, a place in it by their components."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 4
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("vec_id") % _WIDE + at(0)).alias("X"), (F.floor(F.col("vec_id") / _WIDE) + at(1)).alias("Y")
    )


def field_rings(spark, sf_dir):
    """A star per page, and a strip along every row of plots."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    row, column = F.floor(F.col("page_id") / _WIDE), F.col("page_id") % _WIDE

    def ring(corners, x, y):
        return F.array(*[F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y")) for dx, dy in corners])

    stars = pages.select(F.col("page_id").cast("int").alias("Id"), ring(_STAR, column, row).alias("ring"))
    strips = pages.where(column == 0).select((-F.col("page_id") - 1).cast("int").alias("Id"), ring(_STRIP, F.lit(0), row).alias("ring"))
    return stars.unionByName(strips)


def _corner_sql(corners, x, y) -> str:
    return "[" + ", ".join(f"{{'x': CAST({x} + {dx} AS DOUBLE), 'y': CAST({y} + {dy} AS DOUBLE)}}" for dx, dy in corners) + "]"


_FIELD = f"""p AS (SELECT vec_id, vec_id % {_WIDE} + CAST(embedding[1] AS DOUBLE) * 4 AS X,
    vec_id // {_WIDE} + CAST(embedding[2] AS DOUBLE) * 4 AS Y FROM embeddings),
g AS (SELECT CAST(page_id AS INT) AS Id, {_corner_sql(_STAR, f"page_id % {_WIDE}", f"page_id // {_WIDE}")} AS ring FROM pages
  UNION ALL SELECT CAST(-page_id - 1 AS INT), {_corner_sql(_STRIP, "0", f"page_id // {_WIDE}")} FROM pages
    WHERE page_id % {_WIDE} = 0),
e AS (SELECT Id, ring[i].x AS x1, ring[i].y AS y1, ring[i % len(ring) + 1].x AS x2, ring[i % len(ring) + 1].y AS y2
  FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM g)),
h AS (SELECT vec_id, Id FROM p JOIN e ON (y1 > Y) <> (y2 > Y) AND X < (x2 - x1) * (Y - y1) / (y2 - y1) + x1
  GROUP BY vec_id, Id HAVING count(*) % 2 = 1)"""


@query(f"WITH {_FIELD} SELECT vec_id, Id FROM h")
def points_in_many_rings(spark, sf_dir):
    """Every point with every star and strip it lies in."""
    index = ring_index(field_rings(spark, sf_dir))
    return points_in_rings(field_points(spark, sf_dir), index).select("vec_id", "Id")


@query(f"""WITH {_FIELD}, n AS (SELECT vec_id, count(*) AS Rings, min(Id) AS FirstId FROM h GROUP BY vec_id)
SELECT vec_id AS ID2, 'v' || vec_id AS Row2, floor(X * 10000 * 1.000000000001 + 0.5) / 10000 AS X,
  floor(Y * 10000 * 1.000000000001 + 0.5) / 10000 AS Y, FirstId,
  CASE WHEN X IS NOT NULL AND Y IS NOT NULL THEN Rings IS NOT NULL END AS InBoundary, coalesce(Rings, 0) AS Rings
FROM p LEFT JOIN n USING (vec_id)""")
def geojson_points(spark, sf_dir):
    """Reference points and boundaries, each one GeoJSON document, read back in parallel and tagged."""
    points, bounds = fresh(spark, "points"), fresh(spark, "boundaries")
    named = field_points(spark, sf_dir).select(
        F.col("vec_id").alias("ID2"), F.concat(F.lit("v"), "vec_id").alias("Row2"), F.lit(1).alias("Strip"), "X", "Y"
    )
    write_point_features(named, points, "X", "Y", ["ID2", "Row2", "Strip"], ["ID2"])
    write_ring_features(field_rings(spark, sf_dir), bounds, "ring", ["Id"], ["Id"])
    back = read_points(spark, points, {"ID2": "long", "Row2": "string", "Strip": "string"}, folder=True)
    return rounded(tag_in_rings(back, read_rings(spark, bounds, folder=True), ["ID2"]))
