"""Packing by lexical retrieval: BM25 neighbours fill the window of a seed document.

A document is its token ids and the end id. Whole windows of a long document are sequences
of their own; what remains is its tail. Tails are ordered by lexical signature and cut into
index shards of bounded size, so that like texts meet. A shard task builds an inverted
index over its tails and packs greedily: the longest unused tail is the seed, its rarest
terms are the query, and the unused neighbours with the best BM25 scores are taken as long
as they fit. When none of them fits, the best one is cut: its head closes the window and
its rest stays in the shard as a shorter tail. Only the last window of a shard is padded,
and it is laid out in pieces of powers of two where that needs no padding.

Document frequencies cover all tails; there is one number per id of the vocabulary, which
bounds what the driver and the tasks hold of it. A shard holds a bounded number of tails;
equal signatures are told apart by a hash of the row, so copies spread over shards.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each;
an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import functools
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stubble.llm import bpe
from stubble.operators.staging import staged

WINDOW = 1024
#: Tails in an index shard, and terms of a seed that make its query.
SHARD_TAILS = 2000
QUERY_TERMS = 24
K1, B = 1.2, 0.75
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Marks pieces whose ids depend on the text around them; no piece has one byte of ids.
_WHOLE = b"\0"
#: Pieces that a Python worker remembers; an idle worker holds them while other jobs run.
REMEMBERED = 300_000


class WordIds:
    """Ids of whole texts from the ids of their words, equal to the library's.

    A word with the blank before it, and the first word of a line, are encoded alike
    wherever they stand, as long as white space does not meet white space; texts in which
    it does are encoded whole. Texts that hold special strings go to the library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(bpe.byte_alphabet())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        self.coder = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = path
        self.special = [a["content"] for a in spec["added_tokens"]]
        self.size = 1 + max([*ranks.values(), *(a["id"] for a in spec["added_tokens"])])
        self.newline = self.coder.encode_ordinary("\n")[0]
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def library(self):
        """Loaded for the first text that needs it, because it takes 40 MB of a worker."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces: a line's first word, or a word with the blank before it."""

        def good(piece: str) -> bool:
            word = piece[1:] if piece[:1] == " " else piece
            return bool(word) and not word[-1].isspace() and (word is not piece or not word[0].isspace())

        known = self.known
        known.update((p, _WHOLE) for p in pieces if not good(p))
        # A line break before every piece is one id that no piece holds: it parts the ids.
        pieces = [p for p in pieces if p not in known]
        for at in range(0, len(pieces), 2000):
            some = pieces[at : at + 2000]
            ids = np.array(self.coder.encode_ordinary("\n" + "\n".join(some)), dtype="<u4")
            breaks = np.flatnonzero(ids == self.newline)
            if len(breaks) != len(some):  # a piece holds a line break of its own
                known.update((p, np.array(self.coder.encode_ordinary(p), dtype="<u4").tobytes()) for p in some)
                continue
            data, begins = ids.tobytes(), (4 * breaks + 4).tolist()
            ends = [*(b - 4 for b in begins[1:]), len(data)]
            known.update((p, data[a:b]) for p, a, b in zip(some, begins, ends))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as an array of unsigned 32-bit integers."""
        known = self.known
        known["\n"] = np.array([self.newline], dtype="<u4").tobytes()
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        # A text with a zero character cannot be parted at one.
        parted = [
            t.replace(" ", "\0 ").replace("\n", "\0\n\0") if i not in odd and "\0" not in t else ""
            for i, t in enumerate(texts)
        ]
        # Each distinct piece is looked up once.
        split = pc.split_pattern(pa.array(parted, pa.large_string()), "\0")
        pieces, codes, edges = bpe.distinct(split, pa.large_string())
        fresh = [p for p in pieces if p not in known]
        if fresh:
            self._learn(fresh)
        ids = [known[p] for p in pieces]
        # The first pieces are the commoner ones; what was learnt beyond the bound goes again.
        for p in fresh[::-1][: max(0, len(known) - REMEMBERED)]:
            del known[p]
        hard = np.array([i == _WHOLE for i in ids], dtype=bool)[codes]
        at = np.concatenate([[0], np.cumsum(hard)])[edges]
        whole = np.flatnonzero(np.diff(at)).tolist()  # among them empty, odd and zero-holding texts
        out = bpe.spread([b"" if i == _WHOLE else i for i in ids], codes, edges)
        for i in whole:
            text = texts[i]
            found = self.library.encode(text, add_special_tokens=False).ids if i in odd else self.coder.encode_ordinary(text)
            out[i] = np.array(found, dtype=np.uint32)
        return out


@functools.lru_cache(maxsize=2)
def _coder(path: str) -> WordIds:
    return WordIds(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _signature(tail: np.ndarray) -> tuple[int, int]:
    """The commonest id, and a min-hash of neighbouring ids."""
    if len(tail) < 2:
        return (int(tail[0]) if len(tail) else 0), 0
    order = np.sort(tail)
    ends = np.append(np.flatnonzero(order[1:] != order[:-1]), len(order) - 1)
    sizes = ends + 1
    sizes[1:] -= sizes[:-1].copy()
    common = int(order[ends[sizes.argmax()]])  # the least of the commonest
    pairs = tail[:-1].astype(np.uint64) * np.uint64(65537) + tail[1:]
    mixed = (pairs + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return common, int((mixed >> np.uint64(32)).min())


def tokenised(docs: DataFrame, path: str, window: int, end: int, id_col: str, text: str) -> DataFrame:
    """Per row: its id, n tokens, the checksums of its whole windows, its tail and signature."""
    schema = f"doc long, n long, crcs array<long>, tail binary, common int, near long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in bpe.frugal(batches):
            for part, texts in bpe.blocks(batch, "text"):
                out: dict[str, list] = {k: [] for k in ("n", "crcs", "tail", "common", "near")}
                for ids in coder.encode([t.decode("utf-8", "replace") for t in texts]):
                    ids = np.append(ids, np.uint32(end))
                    whole = len(ids) // window * window
                    tail = ids[whole:]
                    common, near = _signature(tail)
                    out["n"].append(len(ids))
                    out["crcs"].append([crc(ids[a : a + window]) for a in range(0, whole, window)])
                    out["tail"].append(tail.astype("<u4").tobytes() if end > 65535 or coder.size > 65536 else tail.astype("<u2").tobytes())
                    out["common"].append(common)
                    out["near"].append(near)
                kinds = {"n": pa.int64(), "crcs": pa.list_(pa.int64()), "tail": pa.binary(), "common": pa.int32(), "near": pa.int64()}
                columns = [pa.array(out[k], kind) for k, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *columns], names=["doc", *kinds])

    return docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def document_frequencies(tails: DataFrame, size: int, wide: bool) -> np.ndarray:
    """In how many tails each id of the vocabulary occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in bpe.frugal(batches):
            for tail in batch.column(0).to_pylist():
                counts[np.unique(np.frombuffer(tail, "<u4" if wide else "<u2"))] += 1
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids], pa.int64())], names=["id", "n"])

    sums = tails.select("tail").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = np.zeros(size, dtype=np.int64)
    for row in sums.collect():  # at most one row per id of the vocabulary
        found[row["id"]] = row["n"]
    return found


class Shard:
    """An inverted index over tails, and the greedy packing of them."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, average: float, window: int):
        self.tails, self.window = tails, window
        self.left = np.array([len(t) for t in tails], dtype=np.int64)
        self.start = np.zeros(len(tails), dtype=np.int64)
        docs, terms, weights, self.query = [], [], [], []
        for d, tail in enumerate(tails):
            term, tf = np.unique(tail, return_counts=True)
            norm = tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tail) / average))
            docs.append(np.full(len(term), d, dtype=np.int32))
            terms.append(term)
            weights.append(idf[term] * norm)
            rare = np.argpartition(-idf[term], min(QUERY_TERMS, len(term)) - 1)[:QUERY_TERMS]
            self.query.append(term[rare])
        term = np.concatenate(terms).astype(np.int64) if terms else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        self.docs = np.concatenate(docs)[order] if docs else np.zeros(0, np.int32)
        self.weights = np.concatenate(weights)[order] if docs else np.zeros(0)
        self.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused tails that share a query term with the seed, best score first."""
        terms = self.query[seed]
        spans = [slice(self.begin[t], self.begin[t + 1]) for t in terms]
        docs = np.concatenate([self.docs[s] for s in spans])
        scores = np.bincount(docs, np.concatenate([self.weights[s] for s in spans]), minlength=len(self.tails))
        scores[self.left == 0] = 0
        found = np.flatnonzero(scores)
        return found[np.lexsort((found, -scores[found]))]

    def pack(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as lists of (tail, start in the tail, length)."""
        seeds = np.lexsort((np.arange(len(self.tails)), -self.left)).tolist()
        waiting = seeds[::-1]  # cut tails come back here
        while waiting:
            seed = waiting.pop()
            if not self.left[seed]:
                continue
            sequence = [self._take(seed, int(self.left[seed]))]
            room = self.window - sequence[0][2]
            if room:
                ranked = self.neighbours(seed)
                for d in ranked.tolist():
                    if self.left[d] <= room:
                        sequence.append(self._take(d, int(self.left[d])))
                        room -= sequence[-1][2]
                        if not room:
                            break
                spare = next((d for d in ranked.tolist() if self.left[d]), None)
                while room:
                    # No neighbour fits: cut the best one, or the next seed without one.
                    while spare is None and waiting:
                        seed = waiting.pop()
                        spare = seed if self.left[seed] else None
                    if spare is None:
                        break
                    sequence.append(self._take(spare, min(room, int(self.left[spare]))))
                    room -= sequence[-1][2]
                    if self.left[spare]:
                        waiting.append(spare)
                    spare = None
            yield sequence

    def _take(self, d: int, n: int) -> tuple[int, int, int]:
        at = int(self.start[d])
        self.start[d] += n
        self.left[d] -= n
        return d, at, n


def _unpadded(sequence: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """A short sequence as sequences whose lengths are powers of two."""
    total = sum(n for _, _, n in sequence)
    if total == window:
        return [sequence]
    out, todo = [], list(sequence)
    for bit in range(total.bit_length() - 1, -1, -1):
        need = total & (1 << bit)
        if not need:
            continue
        part = []
        while need:
            d, at, n = todo.pop(0)
            part.append((d, at, min(n, need)))
            if n > need:
                todo.insert(0, (d, at + need, n - need))
            need -= part[-1][2]
        out.append(part)
    return out


def pack(
    docs: DataFrame, path: str, window: int = WINDOW, end: int = 0, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence_id`` is the task's number and the sequence's number within it.
    """
    coder = WordIds(path)
    size, wide = coder.size, end > 65535 or coder.size > 65536
    rows = staged(tokenised(docs, path, window, end, id_col, text))
    df = document_frequencies(rows, size, wide)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.octet_length("tail")).alias("a")).first()
    total, average = stats["n"], max(1.0, (stats["a"] or 1.0) / (4 if wide else 2))
    idf = np.log1p((total - df + 0.5) / (df + 0.5)).astype(np.float32)
    dealt = rows.repartitionByRange(
        max(1, math.ceil(total / SHARD_TAILS)), "common", "near", F.xxhash64("doc", "tail")
    ).sortWithinPartitions("common", "near", "doc", "n", "tail")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        kind = "<u4" if wide else "<u2"
        held: list[tuple[int, int, list[int], np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal number
            out = []
            for doc, n, crcs, _ in held:
                for k, c in enumerate(crcs):
                    out.append((doc, k * window, window, c, n, number, 0))
                    number += 1
            shard = Shard([h[3] for h in held], idf, average, window)
            for sequence in shard.pack():
                for part in _unpadded(sequence, window):
                    offset = 0
                    for d, at, length in part:
                        doc, n, crcs, tail = held[d]
                        out.append((doc, len(crcs) * window + at, length, crc(tail[at : at + length]), n, number, offset))
                        offset += length
                    number += 1
            held.clear()
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*out)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in bpe.frugal(batches):
            docs_, ns, crcs, tails = (batch.column(i).to_pylist() for i in range(4))
            for doc, n, c, tail in zip(docs_, ns, crcs, tails):
                held.append((doc, n, c, np.frombuffer(tail, kind)))
                if len(held) >= SHARD_TAILS * 2:
                    yield close()
        if held:
            yield close()

    return dealt.select("doc", "n", "crcs", "tail").mapInArrow(run, schema)
