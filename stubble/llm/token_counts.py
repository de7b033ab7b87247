"""Token counts by rank-synchronous merging of pre-tokens in arrays.

The pre-tokens of a batch are held as ragged arrays; in each round every sequence applies
its lowest-rank pair, and the symbols that survive are the tokens. A pre-token that was
counted before is looked up.

Defined cases: null and empty texts have no tokens; special strings inside a text count
one token each; repeated rows are counted alike; extra columns stay, but for one with the
name of the count, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stubble.llm import bpe
from stubble.llm.common import with_fields

_MEMORY: dict[str, bpe.ChunkMemory] = {}


def count_chunks(model: bpe.Bpe, chunks: list[bytes]) -> list[int]:
    """Number of tokens of each chunk."""
    pieces, owner = model.chunk_pieces(chunks)
    _, counts = bpe.merge(model, *model.symbols(pieces))
    return np.bincount(owner, weights=counts, minlength=len(chunks)).astype(np.int64).tolist()


def count_tokens(path: str, texts: list[bytes]) -> list[int]:
    """Number of tokens of each whole text, as the library encodes it without added ones."""
    model = bpe.load(path)
    memory = _MEMORY.setdefault(path, bpe.ChunkMemory(lambda c: count_chunks(model, c)))
    special, starts = bpe.special_pattern(model), [n.encode() for n in model.special]
    cut, extra = [], []
    for t in texts:
        if any(s in t for s in starts):
            chunks, found = bpe.cut_special(t, special)
        else:
            chunks, found = t.split(), ()
        cut.append(chunks)
        extra.append(len(found))
    known = memory.of(cut)
    return [sum(map(known.__getitem__, chunks)) + n for chunks, n in zip(cut, extra)]


def with_token_counts(df: DataFrame, path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """The rows of ``df`` without the text, with the count of its tokens."""
    kept, schema = with_fields(df, text, f"`{name}` long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in bpe.blocks(batch, text):
                counts = pa.array(count_tokens(path, texts), pa.int64())
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), counts], names=names)

    return df.mapInArrow(run, schema)
