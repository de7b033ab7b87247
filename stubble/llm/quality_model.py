"""Quality classifier: a generalised additive model with pairwise interactions.

Each measure of a text is cut into bins. Boosting goes round the measures in a cycle; in each
turn a shallow tree is fitted to the gradient summed per bin, and its leaves are added to
the measure's lookup table. The pairs of measures whose joint table lowers the loss most are
then boosted the same way, with trees that cut both. A score is the sum of one table entry
per measure and per pair, through the logistic function.

Training takes place on at most ``TRAINING_ROWS`` labelled rows, those with the smallest hash
of the id. A threshold on the hash finds them, so no more than these and a few reach the
driver. Scoring is one pass over all rows.

Defined cases: null and empty texts have all measures zero and get a score; labels that
contradict each other for one document count as the smaller; without labels, or with one
kind only, the score is the share of label 1 (one half without any); repeated rows score
alike; an empty table gives an empty result; extra columns with the name of a result are
replaced.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stubble.llm import bpe
from stubble.llm.common import with_fields
from stubble.operators.staging import staged

#: Labelled rows that training uses at most.
TRAINING_ROWS = 20_000
BINS = 32
ROUNDS, RATE, LEAVES = 150, 0.15, 4
PAIRS, PAIR_ROUNDS, PAIR_BINS = 8, 60, 8

MEASURES = (
    "words",
    "word_length",
    "symbols",
    "upper",
    "digits",
    "marks",
    "pipes",
    "beyond_ascii",
    "distinct_words",
    "equal_neighbours",
    "equal_lines",
    "line_length",
    "short_words",
    "long_words",
    "stops",
    "commonest",
)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))


def measures_of(text: bytes) -> tuple[float, ...]:
    """The measures of a whole text, in the order of ``MEASURES``."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(MEASURES)
    chars = sum(map(len, words))

    def share(which: bytes) -> float:
        return (len(text) - len(text.translate(None, which))) / chars

    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = list(map(len, words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return (
        math.log1p(n),
        chars / n,
        share(b"#*$%&<>"),
        share(_UPPER),
        share(_DIGITS),
        share(b"!?"),
        share(b"|"),
        share(_HIGH),
        len(counts) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1.0 - len(set(lines)) / len(lines),
        math.log1p(len(text) / len(lines)),
        sum(x <= 2 for x in lengths) / n,
        sum(x >= 12 for x in lengths) / n,
        share(b".") * chars / n,
        max(counts.values()) / n,
    )


@dataclass
class Model:
    """Bin edges, one table per measure, and tables over pairs of coarser bins."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of measures: bins, lookups, sums."""
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for a, b, table in self.pairs:
            i = np.searchsorted(self.coarse[a], x[:, a], side="right")
            j = np.searchsorted(self.coarse[b], x[:, b], side="right")
            total += table[i, j]
        return 1.0 / (1.0 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value per bin of a tree with at most ``LEAVES`` leaves over summed gradients."""
    spans = [(0, len(g))]
    while len(spans) < LEAVES:
        best = (1e-9, None, None)
        for s, (a, b) in enumerate(spans):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), s, a + k + 1)
        if best[1] is None:
            break
        a, b = spans[best[1]]
        spans[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that cuts both measures of a pair once: its gain and its table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    g00, h00 = cg[:-1, :-1], ch[:-1, :-1]
    g01, h01 = cg[:-1, -1:] - g00, ch[:-1, -1:] - h00
    g10, h10 = cg[-1:, :-1] - g00, ch[-1:, :-1] - h00
    g11, h11 = tg - g00 - g01 - g10, th - h00 - h01 - h10
    gain = _gain(g00, h00) + _gain(g01, h01) + _gain(g10, h10) + _gain(g11, h11) - _gain(tg, th)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for rows, cols, gg, hh in (
        (slice(0, i + 1), slice(0, j + 1), g00, h00),
        (slice(0, i + 1), slice(j + 1, None), g01, h01),
        (slice(i + 1, None), slice(0, j + 1), g10, h10),
        (slice(i + 1, None), slice(j + 1, None), g11, h11),
    ):
        out[rows, cols] = -gg[i, j] / (hh[i, j] + 1.0)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost main tables in a cycle, then the tables of the best pairs."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
    model = Model(math.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return model
    k = x.shape[1]
    model.edges = [_edges(x[:, f], BINS) for f in range(k)]
    model.coarse = [_edges(x[:, f], PAIR_BINS) for f in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(k):
            size = len(model.tables[f])
            g, h = gradients()
            step = RATE * _tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size))
            model.tables[f] += step
            total += step[bins[f]]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def joint(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        at, shape = rough[a] * sizes[b] + rough[b], (sizes[a], sizes[b])
        area = shape[0] * shape[1]
        return _quarters(np.bincount(at, g, area).reshape(shape), np.bincount(at, h, area).reshape(shape))

    g, h = gradients()
    ranked = sorted(((-joint(a, b, g, h)[0], a, b) for a in range(k) for b in range(a + 1, k)))
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            _, step = joint(a, b, *gradients())
            table += RATE * step
            total += RATE * step[rough[a], rough[b]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether the label of a document may not be learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows without their text, with ``measures`` as an array of doubles."""
    kept, schema = with_fields(df, text, "measures array<double>")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in bpe.blocks(batch, text):
                rows = pa.array([measures_of(t) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), rows], names=names)

    return df.mapInArrow(run, schema)


def learnt(features: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """A model from (doc_id, measures) and (doc_id, quality), without held-out documents."""
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(~held_out(F.col("doc_id")))
    both = staged(features.select("doc_id", "measures").join(known, "doc_id"))
    total = both.count()
    # The share of hashes that holds ``rows`` documents or so; the surplus goes.
    span = 1 << 31
    share = span if total <= rows else span * rows // total
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(span)) < share
    sample = both.where(chosen).select(F.xxhash64("doc_id").alias("h"), "*").collect()
    sample = sorted(sample, key=lambda r: (r["h"] % span, r["doc_id"], r["measures"]))[:rows]
    x = np.array([r["measures"] for r in sample], dtype=np.float64).reshape(-1, len(MEASURES))
    y = np.array([1.0 if r["quality"] == 1 else 0.0 for r in sample])
    return fit(x, y)


def with_scores(features: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` to rows that hold ``measures``."""
    kept, schema = with_fields(features, None, "score double")
    names = schema.names
    at = features.columns.index("measures")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(at).flatten()).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(model.scores(x))], names=names)

    return features.mapInArrow(run, schema)


def scored_texts(df: DataFrame, model: Model, text: str = "text", name: str = "quality_score") -> DataFrame:
    """Adds the score to the rows of ``df``, which keep their texts."""
    kept, schema = with_fields(df, None, f"`{name}` double")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in bpe.blocks(batch, text):
                x = np.array([measures_of(t) for t in texts], dtype=np.float64).reshape(-1, len(MEASURES))
                scores = pa.array(model.scores(x))
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), scores], names=names)

    return df.mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document."""
    features = staged(measured(docs.select("doc_id", "text")))
    model = learnt(features, labels)
    return with_scores(features, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
