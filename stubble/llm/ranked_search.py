"""Ranked lexical search by the Best Position Algorithm over impact lists in blocks.

Documents are taken block by block, as tasks read them. A block holds an inverted index:
one row for each of its terms that some query may hold, with the documents, frequencies and
lengths. Which terms those are, tasks learn from a bitmap of fixed size over hashes of the
queries' terms; what it lets through by chance goes at the exact join. Corpus statistics are
sums over all blocks.

The rows of a block meet the queries in groups of at most ``CHUNK`` queries. There each term
has an impact list: its documents by falling contribution to the score. For one query the
lists are read from the top in parallel; a document that turns up is looked up in all other
lists at once, which gives its whole score and marks its place in each list as seen. The best
position of a list is the end of its seen beginning, however it was seen; no unseen document
can contribute more than what stands behind it. Reading stops when the sum of these bounds is
strictly below the k-th best score, so documents of equal score are never lost. The best of
all blocks are ranked together.

Defined cases: null texts, empty texts and texts without terms score nothing and count for
nothing; queries without terms, or whose terms no document holds, have no rows; repeated
query rows with one id are ranked as one query each; repeated documents are ranked each; null
document ids stand behind others of equal score; null query ids are kept; empty tables give
an empty result; further columns are not carried.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stubble.llm.common import ascii_lower
from stubble.operators.staging import staged

#: What is no term: ASCII without letters and digits.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits of the bitmap of query terms.
BITMAP = 1 << 21
#: A block closes at so many documents or so many terms with repeats.
BLOCK_DOCS, BLOCK_TERMS = 16_384, 8_000_000
#: Queries that a task answers together over a block.
CHUNK = 256
#: Places of each list that the first round reads; every round reads twice as many.
FIRST_ROUND = 32
# Fixed values of the score.
K1_1000, B_100, SCALE = 8, 75, 1_000_000_000

_POSTINGS = "block string, term string, df long, docs array<int>, tf array<int>, n array<int>, doc_ids array<bigint>, lengths array<bigint>"
# Bytes of A-Z become a-z, bytes that are in no term become blanks.
_GAP = re.compile(GAPS.removesuffix("+"))
_FOLDED = bytes(32 if b < 128 and _GAP.match(chr(b)) else b for b in range(256)).translate(
    bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
)


def terms_of(col):
    """The terms of a text, in order and with repeats."""
    return F.filter(F.split(ascii_lower(F.coalesce(col, F.lit(""))), GAPS), lambda t: t != "")


# -- the index ---------------------------------------------------------------------------


class Block:
    """The documents of one block, and the wanted terms in them."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms = 0
        self._code: dict[bytes, int] = {}
        self._names: list[str] = []
        self._found: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = text.translate(_FOLDED).split()
        code = self._code
        for word in set(words).difference(code):
            code[word] = -1
            if self.wanted[zlib.crc32(word) % len(self.wanted)]:
                code[word] = len(self._names)
                self._names.append(word.decode("utf-8", "replace"))
        codes = np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=len(words))
        self._found.append(codes[codes >= 0])
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.terms += len(words)

    def rows(self, name: str) -> pa.RecordBatch:
        """A row per term with its postings, and one with the documents' ids and lengths.

        Documents are numbered in the order of their ids, so equal scores need no ids.
        """
        size = len(self.ids)
        order = sorted(range(size), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(size, dtype=np.int64)
        place[order] = np.arange(size)
        lengths = np.array(self.lengths, dtype=np.int64)[order]
        owner = np.repeat(place, [len(f) for f in self._found])
        pairs, tf = np.unique(np.concatenate(self._found) * size + owner, return_counts=True)
        term, doc = pairs // size, pairs % size
        heads = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(heads, len(term))
        offsets = pa.array(ends, pa.int32())

        def lists(values: np.ndarray) -> pa.Array:
            flat = pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))
            return pa.concat_arrays([flat, pa.nulls(1, flat.type)])

        def closing(values: list) -> pa.Array:
            kind = pa.list_(pa.int64())
            return pa.concat_arrays([pa.nulls(len(heads), kind), pa.array([values], kind)])

        columns = {
            "block": pa.array([name] * (len(heads) + 1)),
            "term": pa.array([*(self._names[t] for t in term[heads].tolist()), None], pa.string()),
            "df": pa.array([*np.diff(ends).tolist(), None], pa.int64()),
            "docs": lists(doc),
            "tf": lists(tf),
            "n": lists(lengths[doc]),
            "doc_ids": closing([self.ids[i] for i in order]),
            "lengths": closing(lengths.tolist()),
        }
        return pa.RecordBatch.from_pydict(columns)


def index_blocks(docs: DataFrame, wanted: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The inverted index of the terms in the bitmap, block by block.

    The row without a term holds ids and lengths of all documents of its block, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, block = TaskContext.get().partitionId(), 0, Block(wanted)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, body in zip(batch.column(0), texts):
                block.add(doc_id.as_py(), body.as_py() or b"")
                if block.terms >= BLOCK_TERMS or len(block.ids) >= BLOCK_DOCS:
                    yield block.rows(f"{part}-{number}")
                    number, block = number + 1, Block(wanted)
        if block.ids:
            yield block.rows(f"{part}-{number}")

    chosen = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string"))
    return chosen.mapInArrow(run, _POSTINGS)


def bitmap_of(terms: DataFrame) -> np.ndarray:
    """Which hashes the terms have: at most ``BITMAP`` numbers reach the driver."""
    hashes = terms.select((F.crc32(F.encode("term", "UTF-8")) % BITMAP).cast("int").alias("h")).distinct()
    out = np.zeros(BITMAP, dtype=bool)
    out[hashes.toArrow().column("h").to_numpy()] = True
    return out


# -- the search --------------------------------------------------------------------------


def best_positions(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` best documents, their scores, and the places read of each list.

    A list is its documents by falling impact, and the impacts. Of equal scores the lower
    document comes first.
    """
    impact = np.zeros((len(lists), docs), dtype=np.int64)
    for row, (members, values) in zip(impact, lists):
        row[members] = values
    seen = np.zeros(docs, dtype=bool)
    best = [0] * len(lists)
    found, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin, size, longest = 0, FIRST_ROUND, max((len(m) for m, _ in lists), default=0)
    while begin < longest:
        # Sorted access to the next places of every list; direct access to all others.
        met = np.concatenate([members[begin : begin + size] for members, _ in lists])
        fresh = np.unique(met[~seen[met]])
        seen[fresh] = True
        found = np.concatenate([found, fresh])
        scores = np.concatenate([scores, impact[:, fresh].sum(axis=0)])
        order = np.lexsort((found, -scores))[:k]
        found, scores = found[order], scores[order]
        begin, size = begin + size, size * 2
        bound = 0
        for i, (members, values) in enumerate(lists):
            # The best position moves on behind the places that are seen without a gap.
            while best[i] < len(members):
                ahead = seen[members[best[i] : best[i] + 4096]]
                if ahead.all():
                    best[i] += len(ahead)
                    continue
                best[i] += int(np.argmin(ahead))
                bound += int(values[best[i]])
                break
        if len(scores) == k and bound < scores[-1]:
            break
    return found, scores, begin


def _answers(group: pa.Table, k: int) -> dict[str, list]:
    """The best documents of one block for each query of a chunk."""
    asked: dict[int, list] = {}
    size = 0
    for docs, tf, m, w, uses in zip(*(group.column(c) for c in ("docs", "tf", "m", "w", "uses"))):
        docs, tf, m = (v.values.to_numpy().astype(np.int64) for v in (docs, tf, m))
        values = w.as_py() * ((SCALE * tf) // (1000 * tf + K1_1000 * m))
        order = np.lexsort((docs, -values))
        members, values = docs[order], values[order]
        size = max(size, int(docs[-1]) + 1)
        for use in uses.as_py():
            asked.setdefault(use["query"], []).append((members, values * use["repeats"]))
    out: dict[str, list] = {"query": [], "at": [], "score": []}
    for query, lists in asked.items():
        found, scores, _ = best_positions(lists, size, k)
        out["query"] += [query] * len(found)
        out["at"] += found.tolist()
        out["score"] += scores.tolist()
    return out


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    text: str = "text",
    key: str = "doc_id",
    query_text: str = "text",
    query_key: str = "item_id",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every query."""
    # Query rows get numbers, so that rows with one id stay apart; their terms are counted.
    rows = staged(
        queries.select(F.col(f"`{query_key}`").alias("item_id"), F.col(f"`{query_text}`").alias("text")).withColumn(
            "query", F.monotonically_increasing_id()
        )
    )
    asked = staged(
        rows.select("query", F.explode(terms_of(F.col("text"))).alias("term"))
        .groupBy("query", "term")
        .agg(F.count(F.lit(1)).alias("repeats"))
    )
    index = staged(index_blocks(docs, bitmap_of(asked), text, key))
    postings, closing = index.where("term IS NOT NULL"), index.where("term IS NULL")
    full = F.filter("lengths", lambda n: n > 0)
    total = closing.agg(
        F.coalesce(F.sum(F.size(full)), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.aggregate(full, F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0)).alias("l"),
    ).first()
    counts = postings.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * total["n"] + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    # One row per term and chunk of queries: its weight, and who asks for it how often.
    chunks = -(-rows.count() // CHUNK) or 1
    uses = (
        asked.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)))
        .groupBy("chunk", "term")
        .agg(F.collect_list(F.struct("query", "repeats")).alias("uses"))
    )
    wanted = staged(uses.join(counts, "term").withColumn("w", weight).drop("df").where("w > 0"))
    length = f"transform(n, x -> {100 - B_100}L + ({B_100}L * x * {total['n']}L) div {max(total['l'], 1)}L)"
    lists = postings.join(wanted, "term").select("block", "chunk", "docs", "tf", F.expr(length).alias("m"), "w", "uses")

    def answer(key, group):
        found = _answers(group, k)
        kinds = [("block", pa.string()), ("query", pa.int64()), ("at", pa.int32()), ("score", pa.int64())]
        return pa.table({"block": [key[0].as_py()] * len(found["at"]), **found}, schema=pa.schema(kinds))

    best = lists.groupBy("block", "chunk").applyInArrow(answer, "block string, query long, at int, score long")
    named = closing.select("block", F.posexplode("doc_ids").alias("at", "doc_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = staged(best).join(named, ["block", "at"]).withColumn("rank", F.row_number().over(order))
    return (
        ranked.where(F.col("rank") <= k)
        .join(rows.select("query", "item_id"), "query")
        .select("item_id", "rank", "doc_id", "score")
    )
