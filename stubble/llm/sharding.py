"""Sharding by balanced label propagation.

Documents that share a link key (equal texts, a source page, a duplicate group) are
neighbours. Linked documents start dealt out evenly over the shards; in each round a key
names the shard that holds most of its documents, and every document asks to move to the
shard named by its heaviest key. A quota table of shards x shards admits as many moves as
leave no shard above its capacity; a move into a full shard waits for a round in which
places are free.

The labels found so are then settled for whole groups (the documents led by one key): a
group goes to the shard it names, or, if that has too few places, to another that takes it
whole. Large groups come first, packed together; the others claim places in rounds until
none is left that fits a shard. A key with more documents than a shard is split, and so is
a group that no shard has the places for any more; their documents lie together key by key
in the widest gaps. Documents without neighbours fill the shards up, which makes the sizes
even: counts differ by one at most.

The neighbours of a document are never listed: a round joins documents with one row per
key (partial counts first).

Only the counts per shard, the quotas (shards x shards numbers) and the groups of more than
a sixteenth of a shard (fewer than 17 a shard) reach the driver.

Defined cases: null keys link nothing; a document whose keys are all unique is a filler;
repeated rows are documents of their own; an empty table gives an empty result; extra
columns stay, but for ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stubble.llm.common import let, numbered
from stubble.operators.staging import staged

ROUNDS = 4


def admitted(wanted: dict[tuple[int, int], int], load: list[int], room: list[int]) -> dict[tuple[int, int], int]:
    """The most moves (from, to) that leave every shard within ``room``.

    A shard that would overflow takes fewer, from its largest requests first; that frees
    fewer places elsewhere, so the step repeats. Sums fall each time, so it ends.
    """
    moves = dict(wanted)
    while True:
        into = [0] * len(load)
        for (a, b), n in moves.items():
            into[b] += n
            into[a] -= n
        over = [b for b in range(len(load)) if load[b] + into[b] > room[b]]
        if not over:
            return {pair: n for pair, n in moves.items() if n > 0}
        for b in over:
            excess = load[b] + into[b] - room[b]
            for pair in sorted((p for p in moves if p[1] == b), key=lambda p: (-moves[p], p)):
                cut = min(excess, moves[pair])
                moves[pair] -= cut
                excess -= cut


def _linked(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with a neighbour, rows whose neighbours all share keys beyond a shard, rows without one."""
    df = df.withColumn("__lead", F.lit(None).cast("long"))
    for i, key in enumerate(keys):
        counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        counts = staged(counts.where("__n > 1").withColumnRenamed(key, "__k"))
        number = F.xxhash64(F.lit(i), key)
        df = (
            df.join(counts, df[key] == counts["__k"], "left")
            .withColumn(f"__{key}", F.when(F.col("__n") <= limit, number))
            .withColumn("__lead", F.coalesce("__lead", F.when(F.col("__n") > limit, number)))
            .drop("__n", "__k")
        )
    df = staged(df)
    inner = [f"__{key}" for key in keys]
    free = F.coalesce(*inner).isNull()
    hot = F.col("__lead").isNotNull()
    return df.where(~free).drop("__lead"), df.where(free & hot).drop(*inner), df.where(free & ~hot).drop(*inner, "__lead")


def _requests(linked: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``__lead``, the row's heaviest key, and ``__to``, the shard that it names."""
    votes = []
    for key in keys:
        cells = linked.where(F.col(key).isNotNull()).groupBy(key, "shard").agg(F.count(F.lit(1)).alias("n"))
        # The shard's number decides ties by a hash that differs from key to key.
        top = F.max(F.struct("n", F.xxhash64(key, "shard").alias("tie"), "shard"))
        named = cells.groupBy(F.col(key).alias("__k")).agg(top.alias("__top"))
        vote = f"__vote{len(votes)}"
        linked = linked.join(
            named.select("__k", F.struct("__top.n", "__top.tie", "__top.shard", F.col("__k").alias("lead")).alias(vote)),
            linked[key] == F.col("__k"),
            "left",
        ).drop("__k")
        votes.append(F.col(vote))
    best = F.array_max(F.array(*votes))
    return linked.withColumns({"__lead": best["lead"], "__to": best["shard"]}).drop(*[f"__vote{i}" for i in range(len(votes))])


def packed(groups: list[tuple[int, int, int]], free: list[int]) -> dict[int, int]:
    """A shard for each of the (group, size, named shard) that fits, the largest groups first.

    Groups go where they name; if then one is left over, the tightest fit is tried instead.
    """
    best: dict[int, int] = {}
    for named in (True, False):
        left, found = list(free), {}
        for group, n, to in sorted(groups, key=lambda g: (-g[1], g[0])):
            fits = [s for s in range(len(left)) if left[s] >= n]
            if fits:
                found[group] = to if named and to in fits else min(fits, key=lambda s: (left[s], s))
                left[found[group]] -= n
        if len(found) > len(best) or not named and _rows(groups, found) > _rows(groups, best):
            best = found
        if len(best) == len(groups):
            break
    return best


def _rows(groups: list[tuple[int, int, int]], found: dict[int, int]) -> int:
    return sum(n for group, n, _ in groups if group in found)


def _running(groups: DataFrame, by: list[str], count: int) -> DataFrame:
    """Adds ``__before``: rows of the groups before this one per ``by``, groups of larger sizes first."""
    buckets = max(1, math.isqrt(max(count, 1)))
    dealt = groups.withColumns(
        {"__class": -F.floor(F.log2("n")).cast("int"), "__bucket": F.pmod(F.xxhash64("__lead"), F.lit(buckets))}
    )
    sums = dealt.groupBy(*by, "__class", "__bucket").agg(F.sum("n").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__class", "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = staged(
        sums.select(*by, "__class", "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__first"))
    )
    within = Window.partitionBy(*by, "__class", "__bucket").orderBy("__lead").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(first, [*by, "__class", "__bucket"])
        .withColumn("__before", F.col("__first") + F.coalesce(F.sum("n").over(within), F.lit(0)))
        .drop("__class", "__bucket", "__first")
    )


def _settled(groups: DataFrame, room: list[int]) -> DataFrame:
    """(__lead, shard) of the groups that a shard takes whole; ``groups``: (__lead, n, __to)."""
    large = F.col("n") > max(room) // 16
    top = [(r["__lead"], r["n"], r["__to"]) for r in groups.where(large).collect()]
    found = packed(top, room)
    free = list(room)
    for group, n, _ in top:
        if group in found:
            free[found[group]] -= n
    out = groups.sparkSession.createDataFrame(list(found.items()), "__lead long, shard int")
    pending = groups.where(~large)
    while True:
        places = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).cast("long").alias("free")) for s, n in enumerate(free)])
        fits = F.filter(places, lambda p: p["free"] >= F.col("n"))
        named = F.filter(fits, lambda p: p["s"] == F.col("__to"))
        other = F.get(fits, F.pmod(F.xxhash64("__lead", F.lit(sum(free))), F.size(fits)).cast("int"))
        asked = pending.withColumn("__to", F.when(F.size(named) > 0, F.col("__to")).when(F.size(fits) > 0, other["s"]))
        asked = staged(asked.where("__to IS NOT NULL"))
        count = asked.count()
        if not count:
            return out
        limit = F.element_at(F.array(*[F.lit(n).cast("long") for n in free]), F.col("__to") + 1)
        ranked = staged(_running(asked, ["__to"], count).withColumn("__in", F.col("__before") + F.col("n") <= limit))
        taken = ranked.where("__in")
        for r in taken.groupBy("__to").agg(F.sum("n").alias("n")).collect():
            free[r["__to"]] -= r["n"]
        out = out.unionByName(taken.select("__lead", F.col("__to").alias("shard")))
        pending = ranked.where("NOT __in").select("__lead", "n", "__to")


def balanced_shards(
    df: DataFrame, keys: list[str], shards: int, order: list[str], rounds: int = ROUNDS
) -> DataFrame:
    """Adds ``shard`` (from 0) and ``slot`` (gapless from 0 within the shard).

    ``keys`` are the link columns; ``order`` names columns that tell rows apart (rows equal
    in them are interchangeable).
    """
    spark = df.sparkSession
    base = staged(df.drop("shard", "slot").withColumn("__row", F.xxhash64(*order)))
    total = base.count()
    room = [total // shards + (1 if s < total % shards else 0) for s in range(shards)]
    linked, hot, free = _linked(base, keys, max(room))
    links = [f"__{key}" for key in keys]
    count = linked.count()
    state = staged(
        numbered(linked, [], ["__row", *order], count, "__n")
        .withColumn("shard", (F.col("__n") % shards).cast("int"))
        .drop("__n")
    )
    for _ in range(rounds):
        asked = staged(_requests(state, links).drop("__lead"))
        cells = asked.groupBy("shard", "__to").agg(F.count(F.lit(1)).alias("n")).collect()
        load = [0] * shards
        for r in cells:
            load[r["shard"]] += r["n"]
        wanted = {(r["shard"], r["__to"]): r["n"] for r in cells if r["shard"] != r["__to"]}
        moves = admitted(wanted, load, room)
        if not moves:
            break
        moving = asked.where("shard <> __to")
        if moves == wanted:
            state = asked.withColumn("shard", F.col("__to")).drop("__to")
            continue
        quota = spark.createDataFrame([(a, b, n) for (a, b), n in moves.items()], "shard int, __to int, __q long")
        ranked = numbered(moving, ["shard", "__to"], [*links, "__row", *order], sum(wanted.values()), "__n")
        ranked = ranked.join(quota, ["shard", "__to"], "left")
        goes = F.col("__n") < F.coalesce(F.col("__q"), F.lit(0))
        moved = ranked.withColumn("shard", F.when(goes, F.col("__to")).otherwise(F.col("shard")))
        stays = asked.where("shard = __to").drop("__to")
        state = staged(stays.unionByName(moved.drop("__to", "__n", "__q")))
    led = staged(_requests(state, links).drop("shard", "__n", *links))
    groups = staged(led.groupBy("__lead").agg(F.count(F.lit(1)).alias("n"), F.min("__to").alias("__to")))
    led = staged(led.drop("__to").join(_settled(groups, room), "__lead", "left"))
    state = led.where("shard IS NOT NULL").drop("__lead")
    load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    gaps = [room[s] - load.get(s, 0) for s in range(shards)]
    placed = numbered(state, ["shard"], ["__row", *order], max(1, count // shards), "slot")
    # Rows of groups that no shard takes whole are numbered group by group, the fillers behind them.
    split = staged(led.where("shard IS NULL").drop("shard").unionByName(hot))
    parts = staged(split.groupBy("__lead").agg(F.count(F.lit(1)).alias("n")))
    cut = total - free.count() - sum(load.values())
    starts = staged(_running(parts, [], parts.count()).select("__lead", "__before"))
    split = numbered(split, ["__lead"], ["__row", *order], max(1, cut), "__n").join(starts, "__lead")
    split = split.withColumn("__n", F.col("__n") + F.col("__before")).drop("__before", "__lead")
    free = numbered(free, [], ["__row", *order], max(1, total - count), "__n").withColumn("__n", F.col("__n") + cut)
    # A filler's number lies in the gap of one shard; what remains is its place there.
    at, spans = 0, []
    for s in sorted((s for s in range(shards) if gaps[s] > 0), key=lambda s: (-gaps[s], s)):
        spans.append((s, at, load.get(s, 0)))
        at += gaps[s]
    place = F.array(*[
        F.struct(F.lit(s).alias("s"), F.lit(a).cast("long").alias("at"), F.lit(full).cast("long").alias("full"))
        for s, a, full in spans or [(0, 0, 0)]
    ])
    fillers = split.unionByName(free).withColumn(
        "__gap", let(place, lambda p: F.element_at(F.filter(p, lambda g: g["at"] <= F.col("__n")), -1))
    )
    fillers = fillers.withColumns(
        {"shard": F.col("__gap.s"), "slot": F.col("__gap.full") + F.col("__n") - F.col("__gap.at")}
    )
    return placed.drop("__row").unionByName(fillers.drop("__row", "__n", "__gap"))
