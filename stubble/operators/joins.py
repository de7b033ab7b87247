"""Join operators. Null keys match nulls unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stubble.functions import as_col
from stubble.operators.staging import staged


def attach(
    df: DataFrame,
    lookup: DataFrame,
    keys: list[str] | dict[str, str],
    how: str = "left",
    null_safe: bool = True,
) -> DataFrame:
    """Join a lookup on keys (``{left name: right name}`` if they differ).

    The result holds the columns of ``df`` and the non-key columns of the lookup.
    """
    pairs = list(keys.items()) if isinstance(keys, dict) else [(k, k) for k in keys]
    renamed = lookup.withColumnsRenamed({b: f"__key_{i}" for i, (_, b) in enumerate(pairs)})
    tests = []
    for i, (a, _) in enumerate(pairs):
        l, r = as_col(a), F.col(f"__key_{i}")
        tests.append(l.eqNullSafe(r) if null_safe else l == r)
    on = reduce(lambda x, y: x & y, tests)
    return df.join(renamed, on, how).drop(*[f"__key_{i}" for i in range(len(pairs))])


def attach_group_stats(
    df: DataFrame, stats: DataFrame, keys: list[str], null_safe: bool = True
) -> DataFrame:
    """Join a per-group summary back to its rows.

    The summary is staged, so its true size decides between a broadcast and a shuffle.
    """
    return attach(df, staged(stats), keys, "left", null_safe)


def attach_points_full(df: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer attach of a reference table: unmatched points survive.

    Written as a left join plus the unmatched points, so the large side keeps its
    partitioning and its hot keys can be split; a full outer join allows neither.
    """
    matched = attach(df, points, keys, "left")
    seen = attach(df.select(*keys), points.select(*keys).distinct(), keys, "left_semi").distinct()
    lonely = attach(points, seen, keys, "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def attach_points_inner(
    df: DataFrame, points: DataFrame, key: str, lon: str = "X", lat: str = "Y"
) -> DataFrame:
    """Inner attach by point id; coordinates become Longitude and Latitude."""
    located = attach(df, points, [key], "inner")
    return located.withColumnsRenamed({lon: "Longitude", lat: "Latitude"})


def full_attach(
    left: DataFrame, right: DataFrame, keys: list[str], unique: bool = False
) -> DataFrame:
    """Full outer join of two large tables with complementary columns.

    Keys that are ``unique`` on both sides (as after a groupBy) cannot be hot, so one full
    outer join is best. Otherwise it is an inner join plus both anti joins: adaptive
    execution can split hot keys in all three, which it cannot in a full outer join. Only
    distinct keys cross the anti joins. Both sides are then read three times: stage one
    that is costly to compute.
    """
    if unique:
        theirs = right.withColumnsRenamed({k: f"__key_{i}" for i, k in enumerate(keys)})
        on = [as_col(k).eqNullSafe(F.col(f"__key_{i}")) for i, k in enumerate(keys)]
        both = left.join(theirs, on, "full")
        filled = {k: F.coalesce(as_col(k), F.col(f"__key_{i}")) for i, k in enumerate(keys)}
        return both.withColumns(filled).drop(*[f"__key_{i}" for i in range(len(keys))])
    inner = attach(left, right, keys, "inner")
    left_only = attach(left, right.select(*keys).distinct(), keys, "left_anti")
    right_only = attach(right, left.select(*keys).distinct(), keys, "left_anti")
    return inner.unionByName(left_only, allowMissingColumns=True).unionByName(
        right_only, allowMissingColumns=True
    )


def merge_sides(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    suffixes: tuple[str, str] = (".x", ".y"),
    how: str = "inner",
) -> DataFrame:
    """Join on differing key names; shared other columns get side suffixes."""
    shared = (set(left.columns) & set(right.columns)) - {left_key, right_key}
    l = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    r = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return attach(l, r, {left_key: right_key}, how)


def label_differences(
    df: DataFrame, other: DataFrame, keys: list[str], label: str, other_label: str
) -> DataFrame:
    """Rows whose label differs from another source's label on the same key."""
    return attach(df, other, keys).where(as_col(label) != as_col(other_label))


def apply_corrections(
    df: DataFrame, corrections: DataFrame, keys: list[str], targets: list[str]
) -> DataFrame:
    """Set cells by key: ``corrections`` holds keys, ``Variable`` and ``NewVal``.

    A null ``NewVal`` empties the cell. Raises on a variable that is no target and on two
    corrections of one cell.
    """
    target = F.coalesce(F.col("Variable").isin(targets), F.lit(False))
    unknown = corrections.where(~target).select("Variable").distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"corrected variables that are no targets: {[r[0] for r in unknown]}")
    twice = corrections.groupBy(*keys, "Variable").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"more than one correction of a cell: {[tuple(r) for r in twice]}")
    per_key = corrections.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("Variable") == t, F.struct(F.lit(True).alias("hit"), F.col("NewVal").alias("val")))).alias(f"__new_{t}")
            for t in targets
        ]
    )
    joined = attach(df, staged(per_key), keys, null_safe=False)
    fixed = {
        t: F.when(
            F.col(f"__new_{t}").isNotNull(), F.col(f"__new_{t}.val").cast(df.schema[t].dataType)
        ).otherwise(as_col(t))
        for t in targets
    }
    return joined.withColumns(fixed).drop(*[f"__new_{t}" for t in targets])


def correct(df: DataFrame, target: str, cases: list[tuple[dict, object]]) -> DataFrame:
    """Set one column by literal cases ``({column: value, ...}, new value)``; first hit wins."""
    dtype = df.schema[target].dataType
    expr = None
    for where, new in cases:
        test = reduce(lambda a, b: a & b, [as_col(c) == F.lit(v) for c, v in where.items()])
        value = (new if isinstance(new, Column) else F.lit(new)).cast(dtype)
        expr = F.when(test, value) if expr is None else expr.when(test, value)
    return df.withColumn(target, expr.otherwise(as_col(target)))


def in_ring(x, y, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test of a point against a closed ring, with a bounding-box prefilter."""
    px, py = as_col(x), as_col(y)
    pts = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    # A horizontal edge is never crossed, so it is left out.
    edges = [(a, b) for a, b in zip(pts, pts[1:]) if a[1] != b[1]]
    edge_array = F.array(
        *[
            F.struct(
                F.lit(float(a[0])).alias("x1"),
                F.lit(float(a[1])).alias("y1"),
                F.lit(float(b[0])).alias("x2"),
                F.lit(float(b[1])).alias("y2"),
            )
            for a, b in edges
        ]
    )

    def crossed(e: Column) -> Column:
        straddles = (e["y1"] > py) != (e["y2"] > py)
        at = (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return straddles & (px < at)

    crossings = F.aggregate(
        edge_array, F.lit(0), lambda n, e: n + F.when(crossed(e), 1).otherwise(0)
    )
    boxed = px.between(min(xs), max(xs)) & py.between(min(ys), max(ys))
    return F.when(boxed, crossings % 2 == 1).when(px.isNotNull() & py.isNotNull(), F.lit(False))


def tag_in_boundary(df: DataFrame, lon: str, lat: str, ring, name: str = "InBoundary") -> DataFrame:
    return df.withColumn(name, in_ring(lon, lat, ring))
