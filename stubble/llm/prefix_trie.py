"""Prefix trie of conversations that are rebuilt from another one's head and their own rest.

A sequence of turns has a fingerprint: its length n and a sum of one number per turn times
the place's power of a base, modulo a prime, in ``LANES`` independent lanes. Fingerprints
form a monoid, (n, s) * (m, t) = (n + m, s + base^n t), so the fingerprint of "the first h
turns of one conversation, then a stretch of another" is put together from running sums of
the original conversations; no rebuilt conversation is ever written out. All of it is
integer arithmetic in columns.

Turns are sorted over the whole table (by conversation, turn, role, digest of the text) and
numbered part by part: a part counts its own turns of a conversation, and the parts' totals
are composed, so a conversation with a third of all turns is spread over many tasks.

A node is a group of equal fingerprints of one depth. That its members are equal indeed is
checked by stored turn references: every member refers to the original turn it ends with.
Where the members of a node refer to more than one turn, the turns' roles and texts are
fetched and compared, and all members must continue one parent node; by induction over the
depth the sequences are then equal. If a check fails, the next base is taken.

Sums over subtrees need no walk: a node belongs to its smallest member, and the nodes of one
conversation are the lower end of its path. With T(c) the sum over the nodes of c, a node's
subtree holds T(c) of all members but its owner, and of the owner the sum from that depth on.

Defined cases: rows without a conversation id belong to no conversation; a null turn comes
first; equal turns are ordered by role, then by the SHA-256 of the text, so repeated rows
stand next to each other and count as turns of their own; null role or text is empty; an
empty table gives no node; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stubble.llm.common import SPACES
from stubble.operators.staging import staged

LANES = 3
PRIME = (1 << 31) - 1
#: Bases of the lanes; the next row is taken when fingerprints of unlike sequences meet.
BASES = ((1_103_515_245, 630_360_016, 742_938_285), (950_706_376, 1_226_874_159, 62_089_911))
#: Depths whose sums one window adds up, and ids in one piece of a digest.
STRETCH = 4096
#: Turns that a conversation takes from another one at most.
MOST = 3
SUMS = [f"s{i}" for i in range(LANES)]
FORMER = [f"f{i}" for i in range(LANES)]
KEY = ["depth", *SUMS]
PARENT = ["above", *FORMER]


def _zero() -> Column:
    return F.lit(0).cast("long")


# -- the monoid --------------------------------------------------------------------------


def power(base: int, n: Column) -> Column:
    """``base ** n`` modulo the prime; ``n`` can be negative."""
    exponent = F.pmod(n.cast("long"), F.lit(PRIME - 1))
    squares = [pow(base, 1 << bit, PRIME) for bit in range(31)]
    bits = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(s).cast("long").alias("square")) for b, s in enumerate(squares)])
    return F.aggregate(
        bits,
        _zero() + 1,
        lambda out, x: F.when(F.getbit(exponent, x["bit"]) == 1, out * x["square"] % PRIME).otherwise(out),
    )


def composed(left: Column, lift: Column, right: Column) -> Column:
    """Sum of a product in one lane; ``lift`` is the base to the power of the left one's length."""
    return F.pmod(left + lift * right, F.lit(PRIME))


def less(upto: Column, before: Column) -> Column:
    """Sum of the turns between two running sums, weighted by their places in the whole."""
    return F.pmod(upto - before, F.lit(PRIME))


def turn_numbers(digest: Column) -> list[Column]:
    """One number below the prime per lane, from the hex digest of a turn."""
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % PRIME for i in range(LANES)]


# -- turns -------------------------------------------------------------------------------


def described_turns(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text, digest, words`` of every turn that belongs to a conversation."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    # The length of the role tells where it ends, so no two turns are joined alike.
    joined = F.concat_ws(" ", F.length("role").cast("string"), "role", "text")
    return (
        conversations.where("conv_id IS NOT NULL")
        .select(
            F.col("conv_id").cast("long").alias("conv"),
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            text.alias("text"),
        )
        .withColumn("digest", F.sha2(F.encode(joined, "UTF-8"), 256))
        .withColumn("words", F.size(F.filter(F.split("text", SPACES), lambda w: w != "")).cast("long"))
    )


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """The turns without their texts, staged with the number of the range they lie in."""
    turns = described_turns(conversations).drop("text").withColumn("row", F.monotonically_increasing_id())
    ranges = turns.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "role", "digest", "row")
    return staged(ranges.withColumn("part", F.spark_partition_id()))


def numbered_turns(turns: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """``conv, pos, words, turn, digest`` of every original turn, and the sums with and before it."""
    order = [F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    local = Window.partitionBy("part", "conv").orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumn("at", F.row_number().over(local).cast("long"))
    # Weights count from the part's own first turn; the parts are composed below.
    weights = {f: power(b, F.col("at") - 1) * t % PRIME for f, b, t in zip(FORMER, bases, turn_numbers(F.col("digest")))}
    summed = placed.withColumns(weights).withColumns(
        {s: F.sum(f).over(running) % PRIME for s, f in zip(SUMS, FORMER)}
    )
    summed = staged(summed.withColumns({f: less(F.col(s), F.col(f)) for s, f in zip(SUMS, FORMER)}).drop("row", "role"))
    totals = summed.groupBy("conv", "part").agg(F.max("at").alias("n"), *[F.max_by(s, "at").alias(s) for s in SUMS])
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("before", F.coalesce(F.sum("n").over(earlier), _zero()))
    lifted = before.withColumns({f"l_{s}": power(b, F.col("before")) for s, b in zip(SUMS, bases)})
    sums = {f"b_{s}": F.coalesce(F.sum(F.col(f"l_{s}") * F.col(s) % PRIME).over(earlier), _zero()) % PRIME for s in SUMS}
    starts = staged(lifted.withColumns(sums).drop("n", *SUMS))
    moved = [
        composed(F.col(f"b_{s}"), F.col(f"l_{s}"), F.col(c)).alias(c)
        for names in (SUMS, FORMER)
        for s, c in zip(SUMS, names)
    ]
    return summed.join(starts, ["conv", "part"]).select(
        "conv", (F.col("before") + F.col("at")).alias("pos"), "words", "turn", "digest", *moved
    )


# -- the trie ----------------------------------------------------------------------------


def rebuilt(turns: DataFrame, base: Column, heads: Column, bases: tuple[int, ...]) -> DataFrame:
    """One row per rebuilt conversation and depth: key of its node and of the parent, last turn.

    ``heads`` is how many turns (``MOST`` at most) a conversation takes from the one named by
    ``base``, both made of the column ``conv``. The last turn is a reference: the original
    conversation and place.
    """
    firsts = F.sort_array(F.collect_list(F.when(F.col("pos") <= MOST, F.struct("pos", "words", *SUMS, *FORMER))))
    known = staged(turns.groupBy("conv").agg(F.max("pos").alias("n"), firsts.alias("firsts")))
    theirs = known.select(F.col("conv").alias("base"), F.col("firsts").alias("theirs"))
    none = F.array().cast(known.schema["firsts"].dataType)

    def sums_at(column: str, n: Column) -> Column:
        last = F.get(column, n.cast("int") - 1)
        return F.struct(*[F.when(n > 0, last[s]).otherwise(_zero()).alias(s) for s in SUMS])

    plans = staged(
        known.withColumns({"h": heads.cast("long"), "base": base.cast("long")})
        .join(theirs, "base", "left")
        .withColumn("theirs", F.when(F.col("h") > 0, F.slice("theirs", F.lit(1), F.col("h").cast("int"))))
        .withColumn("theirs", F.coalesce("theirs", none))
        .withColumn("taken", F.size("theirs").cast("long"))
        .select(
            "conv",
            "base",
            "h",
            "taken",
            "theirs",
            (F.col("taken") + F.greatest(F.col("n") - F.col("h"), _zero())).alias("size"),
            sums_at("theirs", F.col("taken")).alias("head"),
            sums_at("firsts", F.least("h", "n")).alias("cut"),
            # The rest moves from behind its own first turns to behind the head.
            F.struct(*[power(b, F.col("taken") - F.col("h")).alias(s) for s, b in zip(SUMS, bases)]).alias("lift"),
        )
    )

    def joined(names: list[str]) -> list[Column]:
        pairs = zip(SUMS, names)
        return [composed(F.col(f"head.{s}"), F.col(f"lift.{s}"), less(F.col(c), F.col(f"cut.{s}"))).alias(c) for s, c in pairs]

    depth = F.col("taken") + F.col("pos") - F.col("h")
    ref = [F.col("conv").alias("ref"), F.col("pos").alias("ref_pos")]
    own = turns.join(plans.drop("theirs"), "conv").where("pos > h")
    rest = own.select("conv", "size", depth.alias("depth"), *joined(SUMS), *joined(FORMER), *ref, "words")
    ref = [F.col("base").alias("ref"), F.col("t.pos").alias("ref_pos")]
    head = plans.select("conv", "size", "base", F.explode("theirs").alias("t")).select(
        "conv", "size", F.col("t.pos").alias("depth"), *[f"t.{c}" for c in (*SUMS, *FORMER)], *ref, "t.words"
    )
    zeros = [_zero().alias(c) for c in ("depth", *SUMS, *FORMER, "ref", "ref_pos", "words")]
    return plans.select("conv", "size", *zeros).unionByName(head).unionByName(rest)


def grouped(rows: DataFrame) -> DataFrame:
    """The nodes: groups of one depth and fingerprint, and what their checks need."""
    checks = [f(c).alias(f"{f.__name__}_{c}") for c in (*FORMER, "ref", "ref_pos") for f in (F.min, F.max)]
    return rows.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), *checks
    )


def equal_members(nodes: DataFrame, rows: DataFrame, turns: DataFrame, conversations: DataFrame) -> bool:
    """Whether the members of every node hold equal turns, by the turns they refer to."""
    differ = lambda names: " OR ".join(f"min_{c} <> max_{c}" for c in names)
    if nodes.where(differ(FORMER)).limit(1).count():
        return False
    several = nodes.where(differ(["ref", "ref_pos"])).select(*KEY)
    refs = rows.join(several, KEY, "left_semi").select(*KEY, F.col("ref").alias("conv"), F.col("ref_pos").alias("pos"))
    # Equal references fall together behind the joins, so that a node with many can be split.
    told = refs.join(turns.select("conv", "pos", "turn", "digest"), ["conv", "pos"])
    found = told.select(*KEY, "conv", "turn", "digest").distinct()
    texts = described_turns(conversations).drop("words")
    same = [found[c].eqNullSafe(texts[c]) for c in ("conv", "turn", "digest")]
    sides = found.join(texts, reduce(lambda a, b: a & b, same)).groupBy(*KEY).agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("role", "text") for f in (F.min, F.max)]
    )
    return not sides.where(differ(["role", "text"])).limit(1).count()


def id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of each node's ``conv``, joined by commas.

    Ids meet in pieces of neighbouring numbers; the pieces of a node pass through one hash in
    order, a few thousand ids at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def done() -> pa.RecordBatch:
            values = [pa.array([v], pa.int64()) for v in key]
            return pa.RecordBatch.from_arrays([*values, pa.array([digest.hexdigest()])], names=[*KEY, "ends_sha256"])

        for batch in batches:
            columns = batch.to_pydict()
            for *found, ids in zip(*(columns[c] for c in (*KEY, "ids"))):
                if found != key:
                    if key is not None:
                        yield done()
                    key, digest = found, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if key is not None:
            yield done()

    piece = F.shiftright("conv", STRETCH.bit_length() - 1)
    pieces = ends.groupBy(*KEY, piece.alias("piece")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    lines = pieces.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))
    placed = lines.repartition(*KEY).sortWithinPartitions(*KEY, "piece")
    return placed.mapInArrow(run, ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string")


def sums_below(owned: DataFrame) -> DataFrame:
    """``conv_id, depth, below``: the sum of ``value`` over a conversation's nodes from there on.

    A long conversation is added up stretch by stretch.
    """
    cut = owned.withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    later = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("conv_id", "stretch").agg(F.sum("value").alias("all"))
    behind = sums.select("conv_id", "stretch", F.coalesce(F.sum("all").over(later), _zero()).alias("behind"))
    within = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    added = cut.withColumn("below", F.sum("value").over(within)).join(staged(behind), ["conv_id", "stretch"])
    return added.select("conv_id", "depth", (F.col("below") + F.col("behind")).alias("below"))


def prefix_trie(conversations: DataFrame, base: Column, heads: Column, bases=BASES) -> DataFrame:
    """The nodes of the trie over all rebuilt conversations, with sums over their subtrees.

    ``base`` and ``heads`` are made of the column ``conv``: the conversation whose first
    turns are taken, and how many. Behind the counts stands the reference of the node's last
    turn: ``turn_conv_id`` and ``turn_place`` (from 1; both null for the root).
    """
    sorted_ = sorted_turns(conversations)
    for chosen in bases:
        turns = staged(numbered_turns(sorted_, chosen))
        rows = staged(rebuilt(turns, base, heads, chosen))
        nodes = staged(grouped(rows))
        if equal_members(nodes, rows, turns, conversations):
            break
    else:
        raise ValueError("fingerprints of unlike sequences meet for all bases")
    # A node's parent and its number of children.
    places = nodes.select(*KEY, "conv_id", "n_convs", "words", (F.col("depth") - 1).alias("above"), *[F.col(f"min_{f}").alias(f) for f in FORMER], "min_ref", "min_ref_pos")
    children = places.where("depth > 0").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"))
    children = children.withColumnsRenamed(dict(zip(PARENT, KEY)))
    parents = nodes.select(F.col("conv_id").alias("parent_conv_id"), *[F.col(k).alias(p) for k, p in zip(KEY, PARENT)])
    linked = staged(
        places.join(children, KEY, "left").join(parents, PARENT, "left").withColumn("n_children", F.coalesce("n_children", _zero()))
    )
    # What each conversation owns: the nodes whose smallest member it is.
    owned = linked.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("value"), "n_children")
    per_owner = staged(
        owned.groupBy("conv_id").agg(
            F.sum("value").alias("own"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf")
        )
    )
    shares = rows.select("conv", *KEY).join(per_owner, rows["conv"] == per_owner["conv_id"])
    sums = shares.groupBy(*KEY).agg(F.sum("own").alias("all"), F.sum("leaf").alias("n_leaves"))
    counted = linked.join(staged(sums), KEY).join(per_owner.drop("leaf"), "conv_id").join(sums_below(owned), ["conv_id", "depth"])
    digests = staged(id_digests(rows.where("size = depth").select(*KEY, "conv")))
    return counted.join(digests, KEY, "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("all") - F.col("own") + F.col("below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        F.when(F.col("depth") > 0, F.col("min_ref")).alias("turn_conv_id"),
        F.when(F.col("depth") > 0, F.col("min_ref_pos")).alias("turn_place"),
    )
