"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first chunk of every
id, level 1 the second chunk of those ids that have one, and so on. Beside each level lie a
continuation bitmap (has this chunk a next one?) and two rank directories: how many bits are
set before each 4096 bits, and from there before each 64. The chunk of an id on the next level
stands at the rank of its bit, so any id is read with one look per level; nothing is decoded
before it.

A file holds whole documents in the order of their ids: a table of documents (id, first place)
and the levels. Files are written by Spark's text writer from rows whose text is the raw bytes
(the line break behind them is the last byte of the format) and read by its binary reader, so
they can lie in any store that Spark reaches. A file closes at ``FILE_IDS`` ids, or at the end
of a longer document. Places over the whole corpus come from the counts of the files: sums per
part, and within a part sums per file.

Defined cases: null and empty texts are the end id alone; null ids come first; rows of one id
stand in the order of the hash of their text, equal rows in any order; an empty table gives no
documents; further columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stubble.llm import bpe
from stubble.llm.common import small_batches
from stubble.operators.staging import staged

#: A file closes when it holds so many ids.
FILE_IDS = 1 << 22
#: Ids of a file that are decoded at once (or those of one longer document).
READ_IDS = 1 << 18
#: Chunks that a Python worker remembers, and chunks that it learns at once.
REMEMBERED = 300_000
LEARNT = 20_000
# Fixed values of the format.
MAGIC = b"DAC1"
END = b"\n"
_FIELDS = ("part", "number", "docs", "ids", "levels")
_WIDE, _NEAR = 4096, 64


# -- one level ---------------------------------------------------------------------------


def _rank_directories(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit words of a bitmap, and the directories of its ranks."""
    packed = np.packbits(bits, bitorder="little")
    words = np.zeros(-(-len(bits) // _NEAR), dtype="<u8")
    words.view(np.uint8)[: len(packed)] = packed
    ones = np.bitwise_count(words).astype(np.int64)
    before = np.cumsum(ones) - ones
    wide = before[:: _WIDE // _NEAR]
    near = before - np.repeat(wide, _WIDE // _NEAR)[: len(before)]
    return words, wide.astype("<u8"), near.astype("<u2")


def encode_ids(ids: np.ndarray) -> list[bytes]:
    """The levels of the ids: chunks, bitmap and the two directories of each."""
    out = []
    left = ids.astype(np.uint32, copy=False)
    while len(left):
        more = left > 0xFF
        out += [left.astype(np.uint8).tobytes(), *(a.tobytes() for a in _rank_directories(more))]
        left = left[more]
        left >>= 8
    return out


class TokenFile:
    """One file in memory. ``ids(places)`` reads single ids, ``documents()`` what it holds."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC or content[-1:] != END:
            raise ValueError("not a file of token ids, or cut off")
        head = np.frombuffer(content, "<u8", len(_FIELDS), 8)
        self.part, self.number, self.docs, self.size, levels = map(int, head)
        at = 8 + head.nbytes

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += -(-out.nbytes // 8) * 8
            return out

        self.doc_ids = take("<i8", self.docs)
        self.known = take("u1", self.docs).astype(bool)
        self.starts = take("<u8", self.docs + 1).astype(np.int64)
        self._levels = []
        for n in take("<u8", levels).tolist():
            words = -(-n // _NEAR)
            self._levels.append((take("u1", n), take("<u8", words), take("<u8", -(-n // _WIDE)), take("<u2", words)))
        if at + 1 != len(content):
            raise ValueError("a file of token ids with a wrong length")

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids at ``places`` (from 0 within the file), each read on its own."""
        at = np.asarray(places, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.uint32)
        who = np.arange(len(at))
        for depth, (chunks, words, wide, near) in enumerate(self._levels):
            out[who] |= chunks[at].astype(np.uint32) << np.uint32(8 * depth)
            word, shift = words[at >> 6], (at & 63).astype(np.uint64)
            on = np.flatnonzero((word >> shift) & np.uint64(1))
            if not len(on):
                break
            at, shift, word = at[on], shift[on], word[on]
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            at = wide[at >> 12].astype(np.int64) + near[at >> 6] + below
            who = who[on]
        return out

    def span(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to ``end``: what follows one another does so on every level."""
        out = np.zeros(end - begin, dtype=np.uint32)
        who = np.arange(end - begin)
        for depth, (chunks, words, wide, near) in enumerate(self._levels):
            if begin == end:
                break
            out[who] |= chunks[begin:end].astype(np.uint32) << np.uint32(8 * depth)
            first, shift = begin >> 6, begin & 63
            bits = np.unpackbits(words[first : -(-end // 64)].view(np.uint8), bitorder="little")
            on = np.flatnonzero(bits[shift : shift + end - begin])
            rank = int(wide[begin >> 12]) + int(near[first]) + int(bits[:shift].sum())
            begin, end, who = rank, rank + len(on), who[on]
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, first place in the file, and ids of every document."""
        begin = 0
        while begin < self.docs:
            first = int(self.starts[begin])
            end = max(begin + 1, int(np.searchsorted(self.starts, first + READ_IDS, side="right")) - 1)
            starts = self.starts[begin : end + 1].tolist()
            ids = self.span(first, starts[-1])
            some = slice(begin, end)
            for doc, known, a, b in zip(self.doc_ids[some].tolist(), self.known[some].tolist(), starts, starts[1:]):
                yield doc if known else None, a, ids[a - first : b - first]
            begin = end


def file_bytes(part: int, number: int, docs: list[tuple[int | None, bytes]]) -> bytes:
    """A file of the documents, given as id and little-endian 32-bit token ids."""
    sizes = np.array([len(b) // 4 for _, b in docs], dtype=np.int64)
    ids = np.frombuffer(b"".join(b for _, b in docs), dtype="<u4")
    levels = encode_ids(ids)
    parts = [
        np.array([i or 0 for i, _ in docs], dtype="<i8").tobytes(),
        np.array([i is not None for i, _ in docs], dtype=np.uint8).tobytes(),
        np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(),
        np.array([len(c) for c in levels[::4]], dtype="<u8").tobytes(),
        *levels,
    ]
    head = np.array([part, number, len(docs), len(ids), len(levels) // 4], dtype="<u8").tobytes()
    padded = (p + bytes(-len(p) % 8) for p in parts)
    return b"".join([MAGIC, bytes(8 - len(MAGIC)), head, *padded])


# -- token ids of texts ------------------------------------------------------------------


def chunk_ids(model: bpe.Bpe, chunks: list[bytes]) -> list[bytes]:
    """The ids of each chunk as little-endian 32-bit integers."""
    pieces, owner = model.chunk_pieces(chunks)
    flat, counts = bpe.merge(model, *model.symbols(pieces))
    ends = 4 * np.cumsum(np.bincount(owner, weights=counts, minlength=len(chunks)).astype(np.int64))
    data = flat.astype("<u4").tobytes()
    begins = [0, *ends.tolist()]
    return [data[a:b] for a, b in zip(begins, begins[1:])]


#: Per file the ids of known chunks, up to ``REMEMBERED`` of them.
_KNOWN: dict[str, dict[bytes, bytes]] = {}


def token_bytes(path: str, texts: list[bytes]) -> list[bytes]:
    """The ids of each whole text, as the library gives them without added ones."""
    model = bpe.load(path)
    known = _KNOWN.setdefault(path, {})
    special, starts = bpe.special_pattern(model), [n.encode() for n in model.special]
    # A text with special strings is a row of parts: text, special, text, ...
    parts, odd = [], {}
    for i, t in enumerate(texts):
        if any(s in t for s in starts):
            odd[i] = special.findall(t)
            parts += special.split(t)
        else:
            parts.append(t)
    # Each distinct chunk is looked up once.
    split = pc.ascii_split_whitespace(pa.array(parts, pa.large_binary()).view(pa.large_string()))
    chunks, codes, edges = bpe.distinct(split, pa.large_binary())
    known[b""] = b""  # before a leading and behind a closing blank
    fresh = [c for c in chunks if c not in known]
    for at in range(0, len(fresh), LEARNT):
        some = fresh[at : at + LEARNT]
        known.update(zip(some, chunk_ids(model, some)))
    ids = [known[c] for c in chunks]
    # The first chunks are the commoner ones; what was learnt beyond the bound goes again.
    for c in fresh[::-1][: max(0, len(known) - REMEMBERED)]:
        del known[c]
    coded = [i.tobytes() for i in bpe.spread(ids, codes, edges)]
    if not odd:
        return coded
    one = {n.encode(): np.array([i], dtype="<u4").tobytes() for n, i in model.special.items()}
    out, rest = [], iter(coded)
    for i in range(len(texts)):
        whole = [next(rest)]
        for name in odd.get(i, ()):
            whole += [one[name], next(rest)]
        out.append(b"".join(whole))
    return out


# -- Spark jobs --------------------------------------------------------------------------


def write_token_files(
    df: DataFrame,
    path: str,
    folder: str,
    end: int | None,
    text: str = "text",
    key: str = "doc_id",
    file_ids: int = FILE_IDS,
) -> None:
    """Write the ids of every text, with the end id behind, to files in the order of ``key``."""
    closing = b"" if end is None else np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, docs, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in bpe.frugal(batches):
            for some, texts in bpe.blocks(batch, "text"):
                ids = some.column(0).to_pylist()
                for doc, coded in zip(ids, token_bytes(path, texts)):
                    docs.append((doc, coded + closing))
                    held += len(docs[-1][1]) // 4
                    if held >= file_ids:
                        yield pa.RecordBatch.from_pydict({"content": [file_bytes(part, number, docs)]})
                        number, docs, held = number + 1, [], 0
        if docs:
            yield pa.RecordBatch.from_pydict({"content": [file_bytes(part, number, docs)]})

    # Equal rows may lie in any order, so a number of the row keeps a repeated row splittable.
    chosen = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    placed = chosen.withColumns({"at": order[1], "row": order[2]})
    sort = [order[0], "at", "row"]
    ordered = placed.repartitionByRange(*sort).sortWithinPartitions(*sort).select("key", "text")
    files = ordered.mapInArrow(run, "content binary")
    # A row is a file; its text is the bytes as they are.
    with small_batches(df.sparkSession):
        files.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    """Path and bytes of each file. No filter stands behind the scan: it would copy every file once more."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def _from_files(spark: SparkSession, folder: str, ddl: str, rows) -> DataFrame:
    """What ``rows(file, path)`` makes of each file, staged; an Arrow batch is one file."""
    names = StructType.fromDDL(ddl).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bpe.frugal(batches):
            for name, content in zip(batch.column(0), batch.column(1)):
                if content := content.as_py():  # a part without documents is an empty file
                    yield pa.RecordBatch.from_arrays(rows(TokenFile(content), name.as_py()), names=names)

    with small_batches(spark, 1):
        return staged(_contents(spark, folder).mapInArrow(run, ddl))


def file_starts(files: DataFrame) -> DataFrame:
    """``part, number, first``: the place of each file's first id, from its ``n_ids``.

    One row per part meets in a window over all parts: as many as tasks wrote files.
    """
    sizes = staged(files.groupBy("part", "number").agg(F.max("n_ids").alias("n_ids")))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = staged(parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(before, "part").select(
        "part", "number", (F.col("before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("first"), "n_ids"
    )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def rows(file: TokenFile, _: str) -> list[pa.Array]:
        docs = [(doc, a, len(ids), zlib.crc32(ids.astype("<u4"))) for doc, a, ids in file.documents()]
        columns = list(zip(*docs)) or [[]] * 4
        same = [pa.array([v] * len(docs), pa.int64()) for v in (file.part, file.number, file.size)]
        return [*same, *(pa.array(c, pa.int64()) for c in columns)]

    ddl = "part long, number long, n_ids long, doc_id long, at long, n_tokens long, ids_crc32 long"
    found = _from_files(spark, folder, ddl, rows)
    starts = staged(file_starts(found).drop("n_ids"))
    return found.join(starts, ["part", "number"]).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, folder: str, places: DataFrame, place: str = "place") -> DataFrame:
    """The id at each place of the corpus (from 0): ``place, token_id``, places met once.

    Only the files that hold a place are decoded, and of them only the ids asked for. Places
    outside the corpus give no row.
    """

    def sizes(file: TokenFile, path: str) -> list[pa.Array]:
        numbers = [pa.array([v], pa.int64()) for v in (file.part, file.number, file.size)]
        return [*numbers, pa.array([path])]

    files = _from_files(spark, folder, "part long, number long, n_ids long, path string", sizes)
    spans = files.join(staged(file_starts(files).drop("n_ids")), ["part", "number"])
    # Spans and places meet by blocks of the corpus; a span covers a few blocks.
    block = lambda c: F.floor(c / F.lit(FILE_IDS))
    last = F.col("first") + F.col("n_ids") - 1
    spread = spans.where("n_ids > 0").select(
        "path", "first", last.alias("last"), F.explode(F.sequence(block(F.col("first")), block(last))).alias("block")
    )
    wanted = places.select(F.col(f"`{place}`").cast("long").alias("place")).distinct()
    found = (
        wanted.withColumn("block", block(F.col("place")))
        .join(spread, "block")
        .where(F.col("place").between(F.col("first"), F.col("last")))
        .select("path", "place", (F.col("place") - F.col("first")).alias("at"))
    )

    def look(key, asked, file):
        if not len(asked) or not len(file):
            return pa.table({"place": pa.array([], pa.int64()), "token_id": pa.array([], pa.int64())})
        ids = TokenFile(file.column("content")[0].as_py()).ids(asked.column("at").to_numpy())
        return pa.table({"place": pc.cast(asked.column("place"), pa.int64()), "token_id": pa.array(ids.astype(np.int64))})

    # A file has FILE_IDS places or those of one document, and they are distinct.
    content = _contents(spark, folder).join(found.select("path").distinct(), "path", "left_semi")
    return found.groupBy("path").cogroup(content.groupBy("path")).applyInArrow(look, "place long, token_id long")
