"""Points in many boundaries against testing every point with every ring."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stubble.operators.spatial import points_in_rings, ring_index, tag_in_rings
from tests.compare import plan_of

RINGS = "Id long, ring array<struct<x:double,y:double>>"


def inside(x, y, parts):
    """Even-odd over all edges of all parts, with the comparisons of ``joins.in_ring``."""
    hit = False
    for ring in parts:
        corners = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
        bad = any(v is None or not math.isfinite(v) for p in corners for v in p)
        if bad or len(corners) < 3:
            continue
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
    return hit


def brute(points, rings):
    parts = {}
    for id, ring in rings:
        parts.setdefault(id, []).append(ring or [])
    known = [(k, x, y) for k, x, y in points if x is not None and y is not None and math.isfinite(x) and math.isfinite(y)]
    return sorted((k, id) for k, x, y in known for id, all_ in parts.items() if inside(x, y, all_))


def found(spark, points, rings):
    table = spark.createDataFrame(points, "key long, X double, Y double")
    index = ring_index(spark.createDataFrame(rings, RINGS))
    return sorted((r["key"], r["Id"]) for r in points_in_rings(table, index).collect())


def random_ring(rng, n, centre, size, whole):
    at = lambda: (rng.uniform(-size, size) + centre[0], rng.uniform(-size, size) + centre[1])
    ring = [at() for _ in range(n)]
    if whole:
        ring = [(float(round(x)), float(round(y))) for x, y in ring]
    return [*ring, ring[0]] if rng.random() < 0.5 else ring


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("whole", [False, True])
def test_equals_every_point_with_every_ring(spark, seed, whole):
    rng = random.Random(seed)
    # Any corners, so edges cross; many sizes; several parts of one id; whole numbers meet cell borders.
    rings = []
    for id in range(60):
        size = rng.choice([0.3, 2, 9, 40] if not whole else [2, 5, 20])
        centre = (rng.uniform(-30, 30), rng.uniform(-30, 30))
        for _ in range(rng.choice([1, 1, 2, 3])):
            rings.append((id, random_ring(rng, rng.choice([3, 4, 7, 30, 90]), centre, size, whole)))
    corners = [p for _, ring in rings for p in ring]
    points = [rng.choice(corners) for _ in range(150)]
    points += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for _, ring in rings for a, b in zip(ring, ring[1:])][:300]
    points += [(rng.uniform(-40, 40), rng.uniform(-40, 40)) for _ in range(300)]
    if whole:
        points += [(float(x), float(y)) for x in range(-20, 20, 2) for y in range(-20, 20, 2)]
    rows = [(i, *p) for i, p in enumerate(points)]
    assert found(spark, rows, rings) == brute(rows, rings)


def test_holes_strips_and_bad_rings(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rings = [(1, square(0.0, 10.0)), (1, square(4.0, 6.0)), (2, [(0.0, 0.0), (10.0, 0.0), (10.0, 1.0), (0.0, 1.0), (0.0, 0.0)])]
    rings += [(3, [(0.0, 0.0), (1.0, 1.0)]), (4, None), (5, []), (6, [(0.0, 0.0), (9.0, None), (9.0, 9.0)])]
    rings += [(7, [(0.0, 0.0), (9.0, float("nan")), (9.0, 9.0)]), (8, [(5.0, 5.0)] * 4), (9, [(0.0, 0.0), (5.0, 5.0), (9.0, 9.0)])]
    rings += [(None, square(-3.0, -1.0))]
    points = [(1, 5.0, 5.0), (2, 1.0, 0.5), (3, 0.0, 0.0), (4, 10.0, 10.0), (5, None, 1.0), (6, 1.0, float("nan")), (7, 1e300, -1e300), (8, -2.0, -2.0)]
    table = spark.createDataFrame(points, "key long, X double, Y double")
    got = {r["key"]: tuple(r)[3:] for r in tag_in_rings(table, spark.createDataFrame(rings, RINGS), ["key"]).select("key", "X", "Y", "InBoundary", "Rings", "FirstId").collect()}
    assert got == {1: (False, 0, None), 2: (True, 2, 1), 3: (True, 2, 1), 4: (False, 0, None), 5: (None, 0, None), 6: (None, 0, None), 7: (False, 0, None), 8: (False, 0, None)}


def test_tiny_and_far_rings(spark):
    rings = [(i, [(1e9 + dx * 1e-3, -1e9 + dy * 1e-3) for dx, dy in ((0, 0), (i, 0), (i, i), (0, i))]) for i in range(1, 4)]
    rings += [(9, [(0.0, 0.0), (1e-9, 0.0), (0.0, 1e-9)])]
    points = [(1, 1e9 + 5e-4, -1e9 + 5e-4), (2, 1e9 + 2.5e-3, -1e9 + 2.5e-3), (3, 1e-10, 1e-10)]
    assert found(spark, points, rings) == brute(points, rings)


def test_no_rings_and_no_points(spark):
    assert found(spark, [(1, 0.0, 0.0)], []) == []
    assert found(spark, [], [(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])]) == []


def test_plan_does_not_grow_with_the_rings(spark):
    points = spark.range(50).select(F.col("id").alias("key"), F.rand(1).alias("X"), F.rand(2).alias("Y"))

    def plan(n):
        rings = [(i, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]) for i in range(n)]
        return plan_of(points_in_rings(points, ring_index(spark.createDataFrame(rings, RINGS))))

    small, large = plan(2), plan(2000)
    assert abs(len(large) - len(small)) < 200
    assert "CartesianProduct" not in large and "NestedLoop" not in large
