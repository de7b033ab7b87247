"""Byte-pair models from tokenizers files: texts to pre-tokens, and merging in arrays.

A text is cut at ASCII white space, which the model drops; what lies between is a chunk.
The library's own normaliser and pre-tokeniser turn chunks into pre-tokens, so their rules
are not repeated here. Only chunks that were not met before are worked on; the memory of
known chunks is cleared at a bound. Chunks of Latin letters with a run of marks behind them
need no library where the file lower-cases and cuts at letters, which is checked on loading.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.iinfo(np.int32).max
#: Known chunks that a Python worker remembers before it starts afresh.
REMEMBERED = 1_000_000
#: Bytes of text that are taken at once within an Arrow batch.
BLOCK_BYTES = 4_000_000
#: Letters whose composed form and lower case are one character, then marks but no apostrophe.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]+)?")
_SPACE = re.compile(r"\s")
#: What a file must say for ``_PLAIN`` chunks to be a lower-cased word and a run of marks.
_PLAIN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """Printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Merges, vocabulary and special strings of a tokenizers file with a BPE model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.decoder = (spec.get("decoder") or {}).get("type")
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = [(self.vocab[a], self.vocab[b]) for a, b in pairs]
        cut = len(model.get("continuing_subword_prefix") or "")
        made = [self.vocab[a + b[cut:]] for a, b in pairs]
        keys = np.array([a * self.size + b for a, b in self.pairs], dtype=np.int64)
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        self.made = np.array(made, dtype=np.int32)
        # Symbols of the 256 bytes, inside a pre-token and at its end.
        letters = byte_alphabet()
        self.inner = np.array([self.vocab.get(c, -1) for c in letters], dtype=np.int32)
        self.last = np.array([self.vocab.get(c + self.suffix, -1) for c in letters], dtype=np.int32)
        self.byte_of = {c: b for b, c in enumerate(letters)}
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {})
        self.plain = normal == _PLAIN_NORMALIZERS and split.get("Regex") == _PLAIN_SPLIT
        self.names = [""] * self.size
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name
        # How often each table slot is asked is unknown, so ranks sit in an open hash table.
        self._bits = 18
        self._slots = np.full(1 << self._bits, -1, dtype=np.int64)
        self._ranks = np.full(1 << self._bits, NONE, dtype=np.int32)
        for key, rank in zip(self._keys.tolist(), self._order.tolist()):
            at = self._slot(key)
            while self._slots[at] >= 0:
                at = (at + 1) & ((1 << self._bits) - 1)
            self._slots[at] = key
            self._ranks[at] = rank

    def _slot(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self._bits)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where the merges have none."""
        keys = a.astype(np.int64) * self.size + b
        at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)
        found = self._slots[at]
        out = np.where(found == keys, self._ranks[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self._bits) - 1)
            found = self._slots[at[open_]]
            same = found == keys[open_]
            out[open_[same]] = self._ranks[at[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out.astype(np.int32)

    def symbols(self, pieces: list[bytes], ended: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of the pre-tokens and the length of each; ``ended``: with their last ones."""
        codes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        flat = self.inner[codes]
        if ended and len(pieces):
            ends = np.cumsum(lens) - 1
            flat[ends] = self.last[codes[ends]]
        return flat, lens

    def chunk_pieces(self, chunks: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Pre-tokens of the chunks in order, and the chunk that each belongs to."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        pieces: list[bytes] = []
        owner: list[int] = []
        hard = range(len(texts))
        if self.plain:
            hard, plain = [], _PLAIN.fullmatch
            for i, text in enumerate(texts):
                if found := plain(text):
                    word, marks = found.groups()
                    pieces.append(word.lower().encode())
                    owner.append(i)
                    if marks:
                        pieces.append(marks.encode())
                        owner.append(i)
                else:
                    hard.append(i)
        if hard:
            more, at = self._library_pieces([texts[i] for i in hard])
            pieces += more
            owner += np.asarray(hard)[at].tolist()
        owners = np.array(owner, dtype=np.int64)
        order = np.argsort(owners, kind="stable")
        return [pieces[i] for i in order.tolist()], owners[order]

    def _library_pieces(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        normal = self.library.normalizer
        if normal is not None:
            if any(map(_SPACE.search, texts)):  # white space beyond ASCII within a chunk
                texts = [normal.normalize_str(t) for t in texts]
            else:
                texts = normal.normalize_str(" ".join(texts)).split(" ")
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        found = self.library.pre_tokenizer.pre_tokenize_str(" ".join(texts))
        pieces = [bytes(map(self.byte_of.__getitem__, p)) for p, _ in found]
        at = np.fromiter((o[0] for _, o in found), dtype=np.int64, count=len(found))
        return pieces, np.searchsorted(starts, at, side="right") - 1


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def merge(model: Bpe, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all sequences to the end: flat symbols that survive and their number per sequence.

    Rank-synchronous: in each round every sequence applies its own lowest-rank pair, at all
    its places at once (from the left where they overlap). Finished sequences leave.
    """
    out: list[np.ndarray] = [None] * 0
    done_at: list[np.ndarray] = []
    counts = np.zeros(len(lens), dtype=np.int64)
    who = np.flatnonzero(lens > 0)
    lens = lens[who]
    ranks = np.full(len(sym), NONE, dtype=np.int32)
    if len(sym) > 1:
        ranks[:-1] = model.rank(sym[:-1], sym[1:])
    ends = np.cumsum(lens)
    ranks[ends - 1] = NONE
    while len(who):
        starts = np.cumsum(lens) - lens
        low = np.minimum.reduceat(ranks, starts)
        active = low < NONE
        if not active.all():
            wide = np.repeat(active, lens)
            out.append(sym[~wide])
            done_at.append(who[~active])
            counts[who[~active]] = lens[~active]
            sym, ranks, who, lens, low = sym[wide], ranks[wide], who[active], lens[active], low[active]
            if not len(who):
                break
        hit = np.flatnonzero(ranks == np.repeat(low, lens))
        # Neighbouring hits overlap (a run of one symbol): every second one is taken.
        new_run = np.empty(len(hit), dtype=bool)
        new_run[0] = True
        new_run[1:] = np.diff(hit) != 1
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
        sym[hit] = model.made[ranks[hit]]
        keep = np.ones(len(sym), dtype=bool)
        keep[hit + 1] = False
        # The pair behind a merged one takes over the place of the symbol it swallowed.
        last = np.zeros(len(sym), dtype=bool)
        last[np.cumsum(lens) - 1] = True
        last[hit] = last[hit + 1]
        lens = np.add.reduceat(keep.astype(np.int64), np.cumsum(lens) - lens)
        sym, last = sym[keep], last[keep]
        ranks = ranks[keep]
        at = np.cumsum(keep)[hit] - 1
        touched = np.concatenate([at, at[at > 0] - 1])
        inside = touched[~last[touched]]
        ranks[touched] = np.where(last[touched], NONE, ranks[touched])
        ranks[inside] = model.rank(sym[inside], sym[inside + 1])
    if not out:
        return sym[:0], counts
    # Sequences ended in different rounds; put them back into their order.
    flat, order = np.concatenate(out), np.concatenate(done_at)
    sizes = counts[order]
    begin = np.empty(len(counts), dtype=np.int64)
    begin[order] = np.cumsum(sizes) - sizes
    total = int(counts.sum())
    steps = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return flat[np.repeat(begin, counts) + steps], counts


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with their texts as UTF-8 bytes (null: empty), each near ``limit`` bytes."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    total, begin = 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= limit or i + 1 == len(sizes):
            part = column.slice(begin, i + 1 - begin).to_pylist()
            yield batch.slice(begin, i + 1 - begin), [t or b"" for t in part]
            total, begin = 0, i + 1


def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory that Arrow no longer uses goes back to the system behind each.

    A worker that has ended its task waits for the next one, with all that the pool still holds.
    """
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def distinct(lists: pa.ListArray, kind: pa.DataType) -> tuple[list, np.ndarray, np.ndarray]:
    """The distinct strings in the lists as ``kind``, the number of each entry's string, and the lists' edges."""
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.view(kind).to_numpy(zero_copy_only=False).tolist()
    return words, coded.indices.to_numpy(), lists.offsets.to_numpy()


def spread(ids: list[bytes], codes: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """The ids of each list: those of its entries, which are given once per distinct string."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    begins = np.cumsum(sizes) - sizes
    n = sizes[codes]
    ends = np.cumsum(n)
    out = flat[np.arange(int(n.sum())) + np.repeat(begins[codes] - (ends - n), n)]
    cuts = np.concatenate([[0], ends])[edges].tolist()
    return [out[a:b] for a, b in zip(cuts, cuts[1:])]


class ChunkMemory:
    """What ``work`` makes of each distinct chunk, remembered up to a bound."""

    def __init__(self, work: Callable[[list[bytes]], list]):
        self.work, self.known = work, {}

    def of(self, texts: list[list[bytes]]) -> dict:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = {c for chunks in texts for c in chunks if c not in self.known}
        if fresh:
            order = list(fresh)
            self.known.update(zip(order, self.work(order)))
        return self.known


def cut_special(text: bytes, special: re.Pattern) -> tuple[list[bytes], list[bytes]]:
    """Chunks of a text without its special strings, and those strings."""
    chunks: list[bytes] = []
    for part in special.split(text):
        chunks.extend(part.split())
    return chunks, special.findall(text)


def special_pattern(model: Bpe) -> re.Pattern:
    names = sorted(model.special, key=len, reverse=True)
    return re.compile(b"|".join(re.escape(n.encode()) for n in names) or b"(?!)")
