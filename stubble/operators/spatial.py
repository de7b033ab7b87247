"""Points in many boundaries: a spatial index over ring edges, joined by grid cell.

Every boundary gets a grid of its own size class, so that it covers a bounded number of cells
whatever its extent; size classes are powers of two, and a point looks once into the grid of
each class that occurs. In each row of cells a ring's edges are known exactly. A cell
that no edge comes near is decided by a parity that all its points share; only inside cells
are kept. A cell that edges come near carries those edges and a parity for the edges further
to the right, so a point is tested against few edges, not against the ring.

The test is the even-odd rule with half-open edges, the same comparisons as
``joins.in_ring``: an edge (x1, y1)-(x2, y2) is crossed when ``(y1 > y) != (y2 > y)`` and
``x`` is left of it at ``y``. The crossings right of a cell need no edges: along a chain of
edges the first condition cancels at every inner corner, so what remains is a constant and
the corners where the chain comes near the cell, which belong to edges the cell carries.

Several rings of one id are parts of one boundary: parts inside one another are holes. A
ring may repeat its first corner at the end or not. Rings with a null, infinite or undefined
corner, of fewer than three corners, or without an id hold no point. A point with a null or
undefined coordinate lies in no ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stubble.functions import as_col
from stubble.operators.joins import attach
from stubble.operators.staging import staged

#: A boundary covers one cell a side for so many corners, within these limits.
CORNERS_A_CELL, LEAST_CELLS, MOST_CELLS = 4, 2, 128
_CELL = ["__class", "__cx", "__cy"]


def _corners(ring: Column) -> Column:
    """The corners of a closed ring without the repeated last one; null if it is none."""
    broken = F.exists(ring, lambda p: F.coalesce(~_finite(p["x"]) | ~_finite(p["y"]), F.lit(True)))
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    closed = (first["x"] == last["x"]) & (first["y"] == last["y"]) & (F.size(ring) > 1)
    open_ = F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)
    return F.when(~broken & (F.size(open_) >= 3), open_)


def _finite(value: Column) -> Column:
    return F.abs(value) < F.lit(float("inf"))


def _unit(size: Column) -> Column:
    return F.pow(F.lit(2.0), size)


def _cell(value: Column, unit: Column) -> Column:
    return F.floor(value / unit)


def _size_classes(parts: DataFrame) -> DataFrame:
    """Per id the exponent of its cell size, from the extent of all its parts."""
    span = [(F.min(F.array_min(f"c.{a}")), F.max(F.array_max(f"c.{a}"))) for a in ("x", "y")]
    bounds = F.greatest(*[high - low for low, high in span]), F.greatest(*[F.abs(v) for pair in span for v in pair])
    # A boundary without extent still needs cells that can be numbered at its place.
    width = F.coalesce(F.nullif(F.greatest("width", F.col("reach") * 2.0**-40), F.lit(0.0)), F.lit(1.0))
    cells = F.greatest(F.lit(LEAST_CELLS), F.least(F.lit(MOST_CELLS), F.col("n") / CORNERS_A_CELL))
    found = parts.groupBy("id").agg(bounds[0].alias("width"), bounds[1].alias("reach"), F.sum(F.size("c")).alias("n"))
    return found.select("id", F.ceil(F.log2(width / cells)).cast("int").alias("__class"))


def _edges(rings: DataFrame, id: str, ring: str) -> DataFrame:
    """One row per edge, with the corners before and behind it and the boundary's size class."""
    parts = rings.select(as_col(id).alias("id"), _corners(as_col(ring)).alias("c")).where("id IS NOT NULL AND c IS NOT NULL")
    sized = attach(parts, staged(_size_classes(parts)), ["id"]).withColumn("n", F.size("c"))
    at = lambda shift: F.get("c", F.pmod(F.col("i") + shift + F.col("n"), F.col("n")))
    return sized.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "id",
        "__class",
        _unit(F.col("__class")).alias("unit"),
        *[at(k - 1).alias(f"p{k}") for k in range(4)],
    )


def _range_in_row(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Least and greatest x of an edge between two heights it reaches."""

    def x_at(y: Column) -> Column:
        cut = a["x"] + (b["x"] - a["x"]) * ((y - a["y"]) / (b["y"] - a["y"]))
        return F.greatest(F.least(cut, F.greatest(a["x"], b["x"])), F.least(a["x"], b["x"]))

    def end(p: Column) -> Column:
        return F.when(p["y"] < low, x_at(low)).when(p["y"] > high, x_at(high)).otherwise(p["x"])

    return F.least(end(a), end(b)), F.greatest(end(a), end(b))


def ring_index(rings: DataFrame, id: str = "Id", ring: str = "ring") -> DataFrame:
    """The staged index of all rings: per cell and id a parity and the edges near the cell.

    ``ring`` is an array of corners (x, y). Edges are spread over the rows of cells they
    reach and there over the cells they come near; both numbers are bounded.
    """
    unit = F.col("unit")
    rows = (
        _edges(rings, id, ring)
        .withColumn(
            "__cy",
            F.explode(F.sequence(*[_cell(f(F.col("p1.y"), F.col("p2.y")), unit) for f in (F.least, F.greatest)])),
        )
        .withColumns({"low": F.col("__cy") * unit, "high": (F.col("__cy") + 1) * unit})
    )
    low, high = F.col("low"), F.col("high")
    left, right = _range_in_row(F.col("p1"), F.col("p2"), low, high)
    reach = {"left": left, "right": right}
    # Where the chain's neighbours begin in this row, if their shared corner lies in it.
    for name, a, b, shared in (("before", "p0", "p1", "p1"), ("behind", "p2", "p3", "p2")):
        least, _ = _range_in_row(F.col(a), F.col(b), low, high)
        reach[name] = F.when(F.col(f"{shared}.y").between(low, high) & (F.col(f"{shared}.y") < high), least)
    # Endpoints at or above the row's upper edge count for every point of the row.
    above = F.when(F.col("p1.y") >= high, 1).otherwise(0) + F.when(F.col("p2.y") >= high, 1).otherwise(0)
    rows = rows.withColumns(reach).withColumn("above", above)
    # An edge comes near the cells it reaches and one more on either side, for rounding.
    near = rows.withColumns({"first": _cell(F.col("left"), unit) - 1, "last": _cell(F.col("right"), unit) + 1})
    key = ["__class", "__cy", "id"]
    carried = near.withColumn("__cx", F.explode(F.sequence("first", "last"))).select(
        *key,
        "__cx",
        F.struct(
            F.col("p1.x").alias("x1"),
            F.col("p1.y").alias("y1"),
            F.col("p2.x").alias("x2"),
            F.col("p2.y").alias("y2"),
            # A corner counts if the neighbour lies right of the cell and is not carried.
            (_cell(F.col("before"), unit) - 1 > F.col("__cx")).alias("first"),
            (_cell(F.col("behind"), unit) - 1 > F.col("__cx")).alias("second"),
        ).alias("edge"),
    )
    border = carried.groupBy(*key, "__cx").agg(F.collect_list("edge").alias("edges"))
    # The parity of a cell sums over the edges that begin further right: a row has few of them.
    steps = near.groupBy(*key, "first").agg((F.sum("above") % 2).alias("above"))
    spans = near.groupBy(*key).agg(F.min("first").alias("from"), F.max("last").alias("to"))
    lines = steps.groupBy(*key).agg(F.collect_list(F.struct("first", "above")).alias("steps"))
    cells = (
        spans.join(lines, key)
        .withColumn("__cx", F.explode(F.sequence("from", "to")))
        .select(
            *key,
            "__cx",
            F.aggregate(
                "steps",
                F.lit(0).cast("long"),
                lambda n, s: n + F.when(s["first"] > F.col("__cx"), s["above"]).otherwise(0),
            ).alias("parity"),
        )
    )
    index = cells.join(border, [*key, "__cx"], "left").withColumn("parity", F.col("parity") % 2 == 1)
    return staged(index.where("edges IS NOT NULL OR parity").select(*_CELL, "id", "parity", "edges"))


def _inside(x: Column, y: Column) -> Column:
    """Even-odd test of a point against the parity and the edges of its cell."""

    def crossings(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        one = lambda test: F.when(test, 1).otherwise(0)
        return (
            F.when(straddles, one(x < at)).otherwise(0)
            + one(F.coalesce(e["first"], F.lit(False)) & (e["y1"] > y))
            + one(F.coalesce(e["second"], F.lit(False)) & (e["y2"] > y))
        )

    edges = F.coalesce("edges", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,first:boolean,second:boolean>>"))
    start = F.when(F.col("parity"), 1).otherwise(0)
    return F.aggregate(edges, start, lambda n, e: n + crossings(e)) % 2 == 1


def points_in_rings(points: DataFrame, index: DataFrame, lon: str = "X", lat: str = "Y", name: str = "Id") -> DataFrame:
    """The points joined with the id of every ring they lie in; a point in none has no row.

    ``index`` comes from ``ring_index``. The number of size classes, not that of the rings,
    decides how often a point is looked up.
    """
    x, y = as_col(lon).cast("double"), as_col(lat).cast("double")
    found = sorted(r[0] for r in index.select("__class").distinct().collect())
    classes = F.array(*map(F.lit, found)).cast("array<int>")
    unit = _unit(F.col("__class"))
    asked = points.withColumns({"__x": x, "__y": y}).where(_finite(F.col("__x")) & _finite(F.col("__y")))
    placed = asked.withColumn("__class", F.explode(classes)).withColumns(
        {"__cx": _cell(F.col("__x"), unit), "__cy": _cell(F.col("__y"), unit)}
    )
    joined = placed.join(index.withColumnRenamed("id", "__id"), _CELL).where(_inside(F.col("__x"), F.col("__y")))
    return joined.drop(*_CELL, "__x", "__y", "parity", "edges").withColumnRenamed("__id", name)


def tag_in_rings(
    points: DataFrame, rings: DataFrame, keys: list[str], lon: str = "X", lat: str = "Y", id: str = "Id", ring: str = "ring"
) -> DataFrame:
    """Every point with ``InBoundary``, the number of rings it lies in and the smallest of their ids.

    ``keys`` tell the points apart. A point without coordinates has a null ``InBoundary``.
    """
    hits = points_in_rings(points.select(*keys, lon, lat), ring_index(rings, id, ring), lon, lat, "__ring")
    per_point = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("Rings"), F.min("__ring").alias(f"First{id}"))
    known = _finite(as_col(lon).cast("double")) & _finite(as_col(lat).cast("double"))
    return attach(points, per_point, keys).withColumns(
        {"InBoundary": F.when(known, F.col("Rings").isNotNull()), "Rings": F.coalesce("Rings", F.lit(0).cast("long"))}
    )
