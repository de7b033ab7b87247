"""N-gram Jaccard join by signature trees.

Every document is the set of its distinct word shingles. Documents with equal sets are one
node (their smallest id). Two sets with similarity t or more share a shingle among the
first ``n - ceil(t n) + 1`` of each in any fixed order, so the documents of a shingle that
stands in such a prefix form a block, and every linked pair meets in a block. The order puts
frequent shingles last, which keeps shared passages out of the prefixes; it affects only
the size of blocks, never the result.

1. Star: every member of a block is compared with the block's smallest node, first by bitmaps
   and sizes, then exactly. That is as many pairs as members, and it joins groups of near
   copies, however large.
2. Trees: in blocks whose members are still in different components, each chunk of members
   is a signature tree whose nodes hold the OR of their members' token bitmaps, the range of
   their set sizes and of their components. A dual traversal goes down only into node pairs
   whose largest possible overlap reaches the threshold. Pairs that also pass the bitmaps of
   full width (two bits or more per shingle) are candidates. Blocks beyond a chunk are
   traversed chunk by chunk pair, so no task holds a whole block. Two sets meet in every block
   they share, and no bound depends on the block; so a member brings the first ``SKETCH`` of
   its blocks along, and a pair is left out of a block if these lists show an earlier one the
   two have in common. In the first block of all nothing leaves it out. Candidates are
   compared exactly.

Pairs that the star has joined need no comparison; so the result is the exact components of
the join, not a list of all pairs.

Defined cases: a document with fewer words than a shingle has one shingle, its whole
sequence; without words or text it has none and links with nothing. Repeated rows are copies
of one document. Ids are unique but for repeated rows. Rows without an id get their number of
shingles, no component, and link with nothing. Extra columns are not carried. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stubble.llm import bpe
from stubble.llm.common import small_batches
from stubble.llm.components import connected_components
from stubble.operators.staging import staged, unstaged

#: Shingles that the order knows as frequent; a longer list would only make blocks smaller.
FREQUENT = 1 << 16
#: Shingles that a task counts at once, and the least count and largest list it reports.
COUNTED, LEAST, REPORTED = 3_000_000, 6, 8_000
#: Members of a block that one tree holds; bits of a tree's bitmaps; children of a tree node.
CHUNK, BITS, FANOUT = 256, 2048, 8
#: Blocks of a member that its rows name.
SKETCH = 16
#: Bits of the filter that tells which documents are candidates (one megabyte).
FILTER_BITS = 1 << 23
#: Postings that a reducer sorts.
POSTINGS = 2_000_000
_STEPS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    count = len(hashes) - width + 1
    total = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : k + count] * _STEPS[k % len(_STEPS)] * np.uint64(2 * (k // len(_STEPS)) + 1)
    return np.unique(_mixed(total))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct sets have a Jaccard similarity of ``percent`` or more."""
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    merged = np.concatenate([a, b])
    merged.sort(kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (both - common)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit per token, at least twice as many bits as tokens, a power of two of them."""
    width = max(BITS, 1 << int(2 * len(tokens)).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(tokens >> np.uint64(20)) % np.uint64(width)] = 1
    return np.packbits(bits)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """The bitmap the same tokens have in fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, width // 8), axis=0)


def may_link(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int) -> bool:
    """Whether the sizes and bitmaps of two sets leave a similarity of ``percent`` possible.

    A bit that only one of two sets has stands for a token or more that the other lacks.
    """
    width = 8 * min(len(a), len(b))
    a, b = folded(a, width), folded(b, width)
    common = int(np.bitwise_count(a & b).sum(dtype=np.int64))
    lacks_a = int(np.bitwise_count(a).sum(dtype=np.int64)) - common
    lacks_b = int(np.bitwise_count(b).sum(dtype=np.int64)) - common
    most = min(na - lacks_a, nb - lacks_b)
    return (100 + percent) * most >= percent * (na + nb)


def _texts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in bpe.frugal(batches):
        for part, texts in bpe.blocks(batch, "text", 16_000_000):
            yield part, [shingles(t, width) for t in texts]


def _sizes_and_frequent(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc, n, same, bits) per document, and (token, seen) of locally frequent shingles."""

    def run(batches):
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        count = 0
        names = ["doc", "n", "same", "bits", "token", "seen"]

        def frequent() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            often = np.flatnonzero(times >= LEAST)
            often = often[np.argsort(-times[often], kind="stable")[:REPORTED]]
            k = len(often)
            gone = [pa.nulls(k, kind) for kind in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            found = [pa.array(tokens[often].view(np.int64)), pa.array(times[often].astype(np.int64))]
            held.clear()
            return pa.RecordBatch.from_arrays([*gone, *found], names=names)

        for part, sets in _texts(batches, width):
            same = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            for key, s in zip(same, sets):
                if key is not None and key not in seen:
                    if len(seen) > bpe.REMEMBERED:
                        seen.clear()
                    seen.add(key)
                    held.append(s)
                    count += len(s)
            k = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(same, pa.binary()),
                    pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                    pa.nulls(k, pa.int64()),
                    pa.nulls(k, pa.int64()),
                ],
                names=names,
            )
            if count >= COUNTED:
                yield frequent()
                count = 0
        if held:
            yield frequent()

    return docs.mapInArrow(run, "doc long, n long, same binary, bits binary, token long, seen long")


def _frequent(first: DataFrame) -> np.ndarray:
    """At most ``FREQUENT`` shingles with the largest counts, the rarest first.

    Counts fall into classes of an eighth of a doubling; the lowest class that is taken
    whole follows from the sizes of the classes, so no task sorts or sends more.
    """
    level = F.floor(F.log2("seen") * 8).cast("int")
    sums = first.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen"))
    sums = staged(sums.withColumn("level", level))
    sizes = {r["level"]: r["n"] for r in sums.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken, least = 0, None
    for at in sorted(sizes, reverse=True):
        taken += sizes[at]
        if taken > FREQUENT:
            break
        least = at
    if least is None:
        return np.zeros(0, np.uint64)
    rows = sums.where(F.col("level") >= least).select("token", "seen").collect()
    rows.sort(key=lambda r: (r["seen"], r["token"]))
    return np.array([r["token"] for r in rows], dtype=np.int64).view(np.uint64)


def _shared_postings(docs: DataFrame, often: np.ndarray, width: int, percent: int, parts: int) -> DataFrame:
    """(token, doc) for prefix shingles that stand in the prefix of two or more documents.

    ``often`` are the frequent shingles, the rarest first. They are known to be shared and
    are only passed through, spread by document; the others meet by token.
    """
    place = np.argsort(often)
    by_value = often[place]

    def frequency(tokens: np.ndarray) -> np.ndarray:
        if not len(often):
            return np.zeros(len(tokens), dtype=np.int64)
        at = np.minimum(np.searchsorted(by_value, tokens), len(by_value) - 1)
        return np.where(by_value[at] == tokens, place[at] + 1, 0)

    def emit(batches):
        seen: set[bytes] = set()
        for part, sets in _texts(batches, width):
            tokens_, docs_, spread = [], [], []
            for doc, s in zip(part.column(0).to_pylist(), sets):
                key = xxhash.xxh3_128_digest(s.tobytes())
                if not len(s) or key in seen:
                    continue
                if len(seen) > bpe.REMEMBERED:
                    seen.clear()
                seen.add(key)
                size = len(s) - (-(-percent * len(s) // 100)) + 1
                rank = frequency(s)
                first = np.lexsort((s, rank))[:size]
                tokens_.append(s[first])
                docs_.append(np.full(size, doc, dtype=np.int64))
                spread.append(np.where(rank[first] > 0, np.uint64(doc & (2**63 - 1)), s[first]))
            if not tokens_:
                continue
            tokens, owners = np.concatenate(tokens_), np.concatenate(docs_)
            bucket = (_mixed(np.concatenate(spread)) % np.uint64(parts * 8)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, tokens, owners = bucket[order], tokens[order], owners[order]
            starts = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
            ends = np.append(starts[1:], len(bucket))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[starts], pa.int64()),
                    pa.array([tokens[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([owners[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ],
                names=["bucket", "tokens", "docs"],
            )

    def keep(batches):
        tokens_, docs_ = [], []
        for batch in batches:
            tokens_ += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            docs_ += [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        if not tokens_:
            return
        tokens, owners = np.concatenate(tokens_), np.concatenate(docs_)
        del tokens_, docs_
        known = frequency(tokens) > 0
        order = np.lexsort((owners[~known], tokens[~known]))
        t, d = tokens[~known][order], owners[~known][order]
        again = (t[1:] == t[:-1]) & (d[1:] != d[:-1])
        twice = np.zeros(len(t), dtype=bool)
        twice[1:] |= again
        twice[:-1] |= again
        t = np.concatenate([t[twice], tokens[known]])
        d = np.concatenate([d[twice], owners[known]])
        for a in range(0, len(t), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(t[a : a + 100_000].view(np.int64)), pa.array(d[a : a + 100_000])], names=["token", "doc"]
            )

    spread = docs.mapInArrow(emit, "bucket long, tokens binary, docs binary")
    return spread.repartition(parts, "bucket").mapInArrow(keep, "token long, doc long")


def _sets_of(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of at least the documents that stand in ``pairs``.

    A bitmap of fixed size tells most other documents apart before their shingles are made;
    the joins with the pairs drop the rest.
    """
    position = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    words = (
        nodes.select(position.alias("p"))
        .groupBy(F.floor(F.col("p") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        .collect()
    )
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in words:
        table[row["w"]] = row["bits"]

    def run(batches):
        for batch in bpe.frugal(batches):
            at = np.asarray(batch.column(2))
            maybe = (table[at // 64] >> (at % 64)) & 1
            some = batch.filter(pa.array(maybe.astype(bool)))
            for part, sets in _texts(iter([some]), width):
                tokens = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), tokens], names=["node", "tokens"])

    rows = docs.where("doc IS NOT NULL").select(F.col("doc").alias("node"), "text")
    return rows.select("node", "text", position.alias("at")).mapInArrow(run, "node long, tokens binary")


def _open_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out."""
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

    def run(batches):
        for batch in bpe.frugal(batches):
            na, ba, nb, bb = (batch.column(k).to_pylist() for k in range(2, 6))
            hit = [
                may_link(np.frombuffer(x, np.uint8), m, np.frombuffer(y, np.uint8), n, percent)
                for m, x, n, y in zip(na, ba, nb, bb)
            ]
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    sizes = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    both = pairs.join(left, "a").join(right, "b").where(sizes)
    return both.select("a", "b", "na", "ba", "nb", "bb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))

    def run(batches):
        for batch in bpe.frugal(batches):
            hit = [
                linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


class SignatureTree:
    """Levels from leaves to root; a level holds bitmaps, sizes, slack and components of its nodes.

    The slack of a set is its size less its set bits: so many of its shingles can share a
    bit with another one.
    """

    def __init__(self, bits: np.ndarray, n: np.ndarray, comp: np.ndarray):
        slack = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, slack, comp, comp)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, s, c0, c1 = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(b, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(s, at),
                    np.minimum.reduceat(c0, at),
                    np.maximum.reduceat(c1, at),
                )
            )


def _possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs can hold a linked pair of different components."""
    (bx, lx, hx, sx, c0x, c1x), (by, ly, hy, sy, c0y, c1y) = x, y
    one = (c0x[i] == c1x[i]) & (c0y[j] == c1y[j]) & (c0x[i] == c0y[j])
    sizes = (100 * hx[i] >= percent * ly[j]) & (100 * hy[j] >= percent * lx[i])
    out = ~one & sizes
    k = np.flatnonzero(out)
    for a in range(0, len(k), 20_000):
        some = k[a : a + 20_000]
        p, q = i[some], j[some]
        common = np.bitwise_count(bx[p] & by[q]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + np.minimum(sx[p], sy[q]), np.minimum(hx[p], hy[q]))
        out[some] = (100 + percent) * most >= percent * (lx[p] + ly[q])
    return out


def dual_traversal(x: SignatureTree, y: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Member pairs (position in x, position in y) that no bound rules out."""
    dx, dy = len(x.levels) - 1, len(y.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        ok = _possible(x.levels[dx], y.levels[dy], i, j, percent)
        i, j = i[ok], j[ok]
        if not len(i) or (dx == 0 and dy == 0):
            return i, j
        if dx >= dy:
            dx -= 1
            i, j = _down(i, j, len(x.levels[dx][1]))
        else:
            dy -= 1
            j, i = _down(j, i, len(y.levels[dy][1]))


def _wide_possible(wide: list[np.ndarray], n: np.ndarray, p: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """``may_link`` of the member pairs (p, q), in arrays per bitmap width."""
    widths = np.array([8 * len(x) for x in wide], dtype=np.int64)
    width = np.minimum(widths[p], widths[q])
    out = (100 * n[p] >= percent * n[q]) & (100 * n[q] >= percent * n[p])
    for w in np.unique(width[out]):
        pairs = np.flatnonzero(out & (width == w))
        members, at = np.unique(np.concatenate([p[pairs], q[pairs]]), return_inverse=True)
        bits = np.stack([folded(wide[m], int(w)) for m in members]).view(np.uint64)
        held = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        a, b = at[: len(pairs)], at[len(pairs) :]
        step = max(1, 4_000_000 // int(w))
        for s in range(0, len(pairs), step):
            i, j, k = a[s : s + step], b[s : s + step], pairs[s : s + step]
            common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[p[k]] - held[i] + common, n[q[k]] - held[j] + common)
            out[k] = (100 + percent) * most >= percent * (n[p[k]] + n[q[k]])
    return out


def _down(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    children = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    inside = children < size
    return children[inside], np.repeat(j, FANOUT)[inside]


def _chunk_pairs(members: DataFrame) -> DataFrame:
    """The members of every block in pairs of chunks, by ``chunks`` of the block."""
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = members.withColumn("own", own).withColumn("other", other)
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "chunks")


def _candidates(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one chunk pair, of different components, that no bound rules out."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    cols = {c: np.asarray(table.column(c)) for c in ("own", "node", "comp", "n")}
    wide = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
    bits = np.stack([folded(x, BITS) for x in wide]).view(np.uint64)
    sides = []
    for chunk in (i, j) if i != j else (i,):
        at = np.flatnonzero(cols["own"] == chunk)
        at = at[np.lexsort((cols["node"][at], cols["n"][at], cols["comp"][at]))]
        sides.append((at, SignatureTree(bits[at], cols["n"][at], cols["comp"][at]) if len(at) else None))
    a, b = sides[0], sides[-1]
    if a[1] is None or b[1] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, q = dual_traversal(a[1], b[1], percent)
    p, q = a[0][p], b[0][q]
    differ = cols["comp"][p] != cols["comp"][q]
    p, q = p[differ], q[differ]
    open_ = _wide_possible(wide, cols["n"], p, q, percent)
    return p[open_], q[open_]


def _tree_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b), few of them more than once.

    ``members``: token, node, comp, n, bits, ``tokens`` (the node's first blocks) and
    ``chunks`` of the block.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        p, q = _candidates(table, percent)
        token, node, lists = table.column("token")[0].as_py(), np.asarray(table.column("node")), table.column("tokens")
        before = {k: {t for t in lists[k].as_py() if t < token} for k in np.unique(np.concatenate([p, q])).tolist()}
        first = [before[x].isdisjoint(before[y]) for x, y in zip(p.tolist(), q.tolist())]
        here = np.array(first, dtype=bool)
        p, q = node[p[here]], node[q[here]]
        low, high = np.minimum(p, q), np.maximum(p, q)
        pairs = np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return _chunk_pairs(members).groupBy("token", "i", "j").applyInArrow(run, "a long, b long")


def _with_chunks(members: DataFrame) -> DataFrame:
    return members.withColumn("chunks", F.ceil(F.col("size") / F.lit(CHUNK)).cast("int")).drop("size")


def similarity_components(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    with small_batches(docs.sparkSession):
        return _components(docs, id_col, text, width, percent)


def _components(docs: DataFrame, id_col: str, text: str, width: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    first = staged(_sizes_and_frequent(docs, width))
    docs = docs.where("doc IS NOT NULL")
    sizes = first.where("token IS NULL").select("doc", "n", "same")
    often = _frequent(first)
    nodes = sizes.where("n > 0 AND doc IS NOT NULL").groupBy("same").agg(F.min("doc").alias("node"))
    own = F.when(F.col("doc").isNotNull(), F.coalesce("node", "doc"))
    members = staged(sizes.join(nodes, "same", "left").select("doc", "n", own.alias("node")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        math.ceil(total * (100 - percent) / 100 / POSTINGS),
    )
    shared = staged(_shared_postings(docs, often, width, percent, parts))
    owners = members.select("doc", "node")
    postings = staged(shared.join(owners, "doc").select("token", "node").distinct())
    unstaged(shared)
    # Shingles with the same members make the same block; one of them is enough.
    mix = F.xxhash64("node")
    alike = postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(mix).alias("x"),
        F.sum(mix.cast("decimal(38,0)")).alias("y"),
        F.min("node").alias("leader"),
    )
    blocks = staged(
        alike.where("size > 1").groupBy("size", "x", "y", "leader").agg(F.min("token").alias("token"))
    )
    inside = staged(postings.join(blocks.select("token", "leader", "size"), "token"))
    unstaged(postings, blocks)
    candidates = inside.select("node").distinct()
    rows = first.where("token IS NULL").select(F.col("doc").alias("node"), "n", "bits")
    sketches = staged(rows.join(candidates, "node", "left_semi").dropDuplicates(["node"]))
    unstaged(first)
    star = inside.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = staged(_open_pairs(star, sketches, percent))
    links = staged(_verified(star, _sets_of(docs, star, width), percent))
    unstaged(star)
    label = staged(connected_components(links))
    # The star has decided blocks of two.
    known = inside.where("size > 2").join(label, "node", "left").select(
        "token", "node", "size", F.coalesce("component", "node").alias("comp")
    )
    known = staged(known)
    unstaged(inside, label)
    split = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_ = known.join(split.where("lo <> hi").select("token"), "token")
    open_ = staged(open_)
    unstaged(known)
    lists = open_.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("token")), 1, SKETCH).alias("tokens"))
    details = staged(lists.join(sketches, "node"))
    pairs = staged(_tree_pairs(_with_chunks(open_.join(details, "node")), percent).distinct())
    unstaged(open_, details, sketches)
    more = staged(_verified(pairs, _sets_of(docs, pairs, width), percent))
    unstaged(pairs)
    label = connected_components(links.unionByName(more))
    return members.join(label, "node", "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "node").alias("component_id"),
    )
