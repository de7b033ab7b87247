"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

From the merge list follows how far to the right of a token the text can still change it:
a merge is disturbed only by an earlier-ranked merge that takes a symbol on the right spine
of its right part, that one only by a still earlier one, and so on; the longest such chain
is the sufficient lookahead (``sufficient_lookahead``). A stream keeps a window of
symbols; tokens that end before the lookahead's reach are stable and are emitted, the rest
waits. What is merged at a time is the window, whatever the length of the pre-token. Streams
of a batch advance side by side over ragged arrays; a batch whose pre-tokens all fit the
window is merged at once. Pre-tokens and ids of a batch are held until it ends.

Decoding is a state machine that takes one id at a time and gives the text that is certain.

Defined cases: null and empty texts give no ids and the empty text; special strings inside
a text are their own ids; repeated rows give the same; extra columns stay, but
for those with the name of a result, which are replaced.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stubble.llm import bpe
from stubble.llm.common import with_fields


@functools.lru_cache(maxsize=4)
def sufficient_lookahead(path: str) -> int:
    """Symbols behind a token beyond which no text can change it."""
    model = bpe.load(path)
    length = np.ones(model.size, dtype=np.int64)
    spine: dict[int, tuple[int, ...]] = {}
    reach: dict[int, int] = {}
    for (a, b), c in zip(model.pairs, model.made.tolist()):
        length[c] = length[a] + length[b]
        spine.setdefault(c, (c, *spine.get(b, (b,))))
        # Only earlier merges are in ``reach`` by now: those that can disturb this one.
        look = max((reach.get(p, 0) for p in spine.get(b, (b,))), default=0)
        reach[a] = max(reach.get(a, 0), int(length[b]) + look)
    return max(reach.values(), default=0)


def encode_pieces(model: bpe.Bpe, pieces: list[bytes], lookahead: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens, flat, and their number per pre-token.

    Each pre-token is a stream that is read at most ``window`` symbols at a time.
    """
    window = max(window, 2 * lookahead + 2)
    emitted: list[list[np.ndarray]] = [[] for _ in pieces] if any(len(p) > window for p in pieces) else []
    if not emitted:
        return bpe.merge(model, *model.symbols(pieces))
    read = [0] * len(pieces)
    live = list(range(len(pieces)))
    symbols_of = _lengths(model)
    while live:
        parts = [pieces[i][read[i] : read[i] + window] for i in live]
        ended = np.array([read[i] + len(p) >= len(pieces[i]) for i, p in zip(live, parts)])
        sym, lens = model.symbols(parts)
        # A window that does not end its pre-token has an inner symbol at its end.
        for k in np.flatnonzero(~ended):
            sym[int(lens[: k + 1].sum()) - 1] = model.inner[parts[k][-1]]
        flat, counts = bpe.merge(model, sym, lens)
        begin, still = 0, []
        for k, i in enumerate(live):
            ids = flat[begin : begin + counts[k]]
            begin += int(counts[k])
            if not ended[k]:
                reach = np.cumsum(symbols_of[ids])
                ids = ids[reach <= len(parts[k]) - lookahead]
                read[i] += int(symbols_of[ids].sum())
                still.append(i)
            emitted[i].append(ids)
        live = still
    whole = [np.concatenate(e) if e else np.zeros(0, np.int32) for e in emitted]
    return np.concatenate(whole), np.array([len(w) for w in whole], dtype=np.int64)


def _lengths(model: bpe.Bpe) -> np.ndarray:
    cut = len(model.suffix)
    sizes = [len(n) - (cut if cut and n.endswith(model.suffix) else 0) for n in model.names]
    return np.array(sizes, dtype=np.int64)


class Decoder:
    """Ids in, text out, one at a time.

    A file without a decoder joins the names of tokens by blanks. A byte-level one maps the
    names to bytes; bytes of an unfinished character wait in the state.
    """

    def __init__(self, model: bpe.Bpe):
        self.model, self.first = model, True
        self.special = set(model.special.values())
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace") if model.decoder == "ByteLevel" else None

    def feed(self, token: int) -> str:
        name = self.model.names[token]
        if self.utf8 is None:
            text = name if self.first else " " + name
            self.first = False
            return text
        if token in self.special:
            return self.utf8.decode(name.encode())
        return self.utf8.decode(bytes(map(self.model.byte_of.__getitem__, name)))

    def end(self) -> str:
        return "" if self.utf8 is None else self.utf8.decode(b"", True)


def decode(model: bpe.Bpe, ids: Iterable[int]) -> str:
    machine = Decoder(model)
    return "".join([*map(machine.feed, ids), machine.end()])


_MEMORY: dict[tuple[str, int], bpe.ChunkMemory] = {}


def encode_chunks(path: str, chunks: list[bytes], window: int) -> list[bytes]:
    """Ids of each chunk as little-endian unsigned 32-bit integers."""
    model = bpe.load(path)
    pieces, owner = model.chunk_pieces(chunks)
    flat, counts = encode_pieces(model, pieces, sufficient_lookahead(path), window)
    per_chunk = np.bincount(owner, weights=counts, minlength=len(chunks)).astype(np.int64)
    data = flat.astype("<u4").tobytes()
    ends = (np.cumsum(per_chunk) * 4).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def encode_texts(path: str, texts: list[bytes], window: int = 1024) -> list[bytes]:
    """Ids of each whole text as little-endian unsigned 32-bit integers."""
    model = bpe.load(path)
    work = lambda c: encode_chunks(path, c, window)
    memory = _MEMORY.setdefault((path, window), bpe.ChunkMemory(work))
    special, starts = bpe.special_pattern(model), [n.encode() for n in model.special]
    ids_of = {n.encode(): np.array([i], dtype="<u4").tobytes() for n, i in model.special.items()}
    cut: list[list[list[bytes]]] = []
    found: list[list[bytes]] = []
    for t in texts:
        if any(s in t for s in starts):
            cut.append([part.split() for part in special.split(t)])
            found.append(special.findall(t))
        else:
            cut.append([t.split()])
            found.append([])
    known = memory.of([chunks for parts in cut for chunks in parts])
    out = []
    for parts, names in zip(cut, found):
        data = [b"".join(map(known.__getitem__, parts[0]))]
        for name, chunks in zip(names, parts[1:]):
            data.append(ids_of[name])
            data.extend(map(known.__getitem__, chunks))
        out.append(b"".join(data))
    return out


def decode_to_digest(model: bpe.Bpe, ids: bytes, step: int = 4096) -> str:
    """SHA-256 of the decoded text, fed to the digest as the state machine gives it."""
    machine, digest = Decoder(model), hashlib.sha256()
    numbers = np.frombuffer(ids, dtype="<u4")
    if machine.utf8 is None:  # names stand alone: a step of them is one join
        for at in range(0, len(numbers), step):
            names = map(model.names.__getitem__, numbers[at : at + step].tolist())
            digest.update(((" " if at else "") + " ".join(names)).encode())
        return digest.hexdigest()
    for token in numbers.tolist():
        digest.update(machine.feed(token).encode())
    digest.update(machine.end().encode())
    return digest.hexdigest()


def with_ids(df: DataFrame, path: str, text: str = "text", window: int = 1024) -> DataFrame:
    """Adds ``ids`` (little-endian unsigned 32-bit integers); the text goes.

    ``encode_texts`` and ``decode`` are the forms for single batches.
    """
    return _mapped(df, text, {"ids": "binary"}, lambda texts: [pa.array(encode_texts(path, texts, window), pa.binary())])


def with_digests(df: DataFrame, path: str, text: str = "text", window: int = 1024) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256; the text goes."""

    def digests(texts: list[bytes]) -> list[pa.Array]:
        model = bpe.load(path)
        ids = encode_texts(path, texts, window)
        return [
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
            pa.array([decode_to_digest(model, i) for i in ids], pa.string()),
        ]

    names = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return _mapped(df, text, names, digests)


def _mapped(df: DataFrame, text: str, added: dict[str, str], work) -> DataFrame:
    kept, schema = with_fields(df, text, ", ".join(f"{name} {kind}" for name, kind in added.items()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in bpe.blocks(batch, text):
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), *work(texts)], names=names)

    return df.mapInArrow(run, schema)
