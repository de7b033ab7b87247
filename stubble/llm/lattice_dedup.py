"""Near duplicates of embeddings by E8 lattice hashing.

A vector is normalised and projected at random to eight numbers (several times eight for
large tables); each eight are rounded to the nearest point of the E8 lattice. The points are
the vector's home cell in one table; several tables use projections of their own. A vector
is filed under its home cell and also looks into the cells around it that are nearest to it.
Vectors that meet in a cell are compared exactly, by cosine in double precision.

The scale of the lattice and the number of eights follow from the number of vectors, so
that a cell holds few vectors by chance at any size. The number of tables follows from them
and the threshold: it is measured how often vectors at exactly the threshold meet, and there
are as many tables as find more than nine tenths of such pairs at any size. Cells are looked up by narrow rows;
vectors are attached only in cells where two or more meet. A cell with very many vectors
is compared chunk by chunk pair. A pair that meets more than once is counted where it meets
first, which the task finds from the two vectors alone; so links are counted without a table
of all pairs, and only a spanning forest of each comparison leaves its task.

Equal vectors are one class, filed once with its size.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths are never compared; repeated rows are
vectors of their own; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stubble.llm.components import connected_components
from stubble.operators.staging import staged

#: Vectors of a cell that are compared at once.
CHUNK = 512
#: Rows of unrelated vectors that the cell of a row holds at most, on average.
CROWD = 128
#: Units of the lattice to choose from, the widest first; beyond 1.2 nearly all vectors share a cell.
SCALES = tuple(1.2 * 0.93**k for k in range(20))


@dataclass(frozen=True)
class Lattice:
    """``eights`` E8 points make a cell; ``scale`` is the unit of the lattice."""

    eights: int
    scale: float
    tables: int
    probes: int
    seed: int = 20


def lattice_for(
    vectors: int, least: float = 0.9, dims: tuple[int, ...] = (64,), probes: int = 3, missed: float = 0.07
) -> Lattice:
    """Cells of at most ``CROWD`` unrelated rows, in as many tables as links at ``least`` need.

    The collision of pairs at a cosine of exactly ``least`` is measured on made pairs of every
    dimension; tables are added until a pair meets in none with a probability of ``missed``.
    Of the numbers of eights, the one that needs the fewest tables is taken.
    """
    found = []
    for eights in range(1, 9):
        # The widest unit with which a row's cell holds CROWD unrelated rows at most.
        fine = [x for x in SCALES if vectors * _crowding(x, probes, eights) <= CROWD]
        if not fine:
            continue
        meet = min((_collision(dim, Lattice(eights, fine[0], 4, probes), least) for dim in dims), default=1.0)
        if meet > 0:
            tables = 1 if meet >= 1 - missed else math.ceil(math.log(missed) / math.log1p(-meet))
            found.append(Lattice(eights, fine[0], tables, probes))
        if fine[0] == SCALES[0]:
            break  # more eights only split cells that are small enough
    return min(found, key=lambda one: (one.tables * one.eights**0.25, one.eights))


@functools.lru_cache(maxsize=256)
def _alike(scale: float, probes: int) -> tuple[float, float]:
    """For two unrelated vectors and one eight: shared home cells and shared cells, on average."""
    x = np.random.default_rng(7).normal(size=(5000, 8)) / math.sqrt(8)
    cells = cells_of(x, Lattice(1, scale, 1, probes))[:, 0]
    shared = []
    for some in (cells[:, 0], cells.ravel()):
        n = np.unique(some, return_counts=True)[1].astype(float)
        shared.append((n * (n - 1)).sum() / (len(x) * (len(x) - 1)))
    return shared[0], shared[1]


def _crowding(scale: float, probes: int, eights: int) -> float:
    """Rows of unrelated vectors in the cell of a row, per vector of the table."""
    home, any_cell = _alike(scale, probes)
    return home ** (eights - 1) * any_cell / (1 + probes)


def measured_dims(lengths: Iterable[int]) -> tuple[int, ...]:
    """Dimensions at which collisions are measured: small ones as they are, others as powers of two."""
    return tuple(sorted({n if n <= 32 else min(256, 1 << (n.bit_length() - 1)) for n in lengths if n > 1}))


def made_pairs(count: int, dim: int, cosine: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors and partners at exactly ``cosine``."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(count, dim)), rng.normal(size=(count, dim))
    a /= np.sqrt((a * a).sum(axis=1))[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.sqrt((b * b).sum(axis=1))[:, None]
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * b


def meetings(a: np.ndarray, b: np.ndarray, lattice: Lattice) -> np.ndarray:
    """(pairs, tables) whether the home cell of one is a cell of the other."""
    p, q = cells_of(a, lattice), cells_of(b, lattice)
    return (p[:, :, :1] == q).any(axis=2) | (q[:, :, :1] == p).any(axis=2)


@functools.lru_cache(maxsize=256)
def _collision(dim: int, lattice: Lattice, cosine: float) -> float:
    a, b = made_pairs(1000, dim, cosine, lattice.seed)
    return float(meetings(a, b, lattice).mean())


@functools.lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bits.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    worst = np.argmax(np.abs(off), axis=1)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    near[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: of D8, or of D8 moved by one half."""
    a = _nearest_d8(x)
    b = _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@functools.lru_cache(maxsize=8)
def _directions(dim: int, lattice: Lattice) -> np.ndarray:
    """(tables * eights * 8, dim): orthonormal within a table where the dimension allows it."""
    rng = np.random.default_rng(lattice.seed)
    width = 8 * lattice.eights
    out = []
    for _ in range(lattice.tables):
        g = rng.normal(size=(max(dim, width), width))
        out.append(np.linalg.qr(g)[0][:dim].T)
    return np.concatenate(out) * np.sqrt(dim / 8.0)


def cells_of(unit: np.ndarray, lattice: Lattice) -> np.ndarray:
    """(vectors, tables, 1 + probes) cell numbers; the first is the home cell.

    Sums run over one dimension at a time, so a vector gets the same cells in any batch.
    """
    n, dim = unit.shape
    directions = _directions(dim, lattice)
    flat = np.zeros((n, len(directions)))
    for d in range(dim):
        flat += unit[:, d : d + 1] * directions[:, d]
    points = (flat / lattice.scale).reshape(n, lattice.tables, lattice.eights, 8)
    out = np.empty((n, lattice.tables, 1 + lattice.probes), dtype=np.uint64)
    around = roots()
    for t in range(lattice.tables):
        home = np.stack([nearest_e8(points[:, t, e]) for e in range(lattice.eights)], axis=1)
        gain = np.empty((n, lattice.eights, len(around)))
        for e in range(lattice.eights):
            rest = points[:, t, e] - home[:, e]
            g = np.zeros((n, len(around)))
            for k in range(8):
                g += rest[:, k : k + 1] * around[:, k]
            gain[:, e] = g
        best = np.argsort(-gain.reshape(n, -1), axis=1, kind="stable")[:, : lattice.probes]
        out[:, t, 0] = _numbers(home, t, dim)
        for p in range(lattice.probes):
            e, r = best[:, p] // len(around), best[:, p] % len(around)
            near = home.copy()
            near[np.arange(n), e] += around[r]
            out[:, t, 1 + p] = _numbers(near, t, dim)
    return out


def _numbers(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """64-bit numbers of lattice points, apart by table and dimension."""
    twice = np.rint(2 * points).astype(np.int64).reshape(len(points), -1).view(np.uint64)
    start = (table + 1) * 0x9E3779B97F4A7C15 + dim * 0xC2B2AE3D27D4EB4F
    h = np.full(len(points), start & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k in range(twice.shape[1]):
        h = (h ^ twice[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def _units(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision of equally long raw vectors."""
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1)[:, None]  # lengths beyond the range of squares stay finite
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _raw(column: pa.Array) -> list[bytes | None]:
    """The components in double precision as bytes; None where a vector links with nothing."""
    out = []
    for v in column.to_pylist():
        raw = None
        if v and None not in v:
            x = np.asarray(v, dtype="<f8") + 0.0  # one zero, without a sign
            if np.isfinite(x).all() and x.any():
                raw = x.tobytes()
        out.append(raw)
    return out


def _stacks(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and unit vectors, one stack per dimension."""
    lengths = np.array([len(r) for r in raw])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, _units([raw[i] for i in at])


def _keyed(df: DataFrame) -> DataFrame:
    """(vec, same): a key of the exact vector, null where it links with nothing."""

    def run(batches):
        for batch in batches:
            keys = [r and xxhash.xxh3_128_digest(r) for r in _raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["vec", "same"])

    return df.select("vec", "embedding").mapInArrow(run, "vec long, same binary")


def _with_raw(reps: DataFrame) -> DataFrame:
    """(vec, size, raw): the components as bytes."""

    def run(batches):
        for batch in batches:
            raw = pa.array(_raw(batch.column(2)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], names=["vec", "size", "raw"])

    return reps.select("vec", "size", "embedding").mapInArrow(run, "vec long, size long, raw binary")


def _filed(reps: DataFrame, lattice: Lattice) -> DataFrame:
    """(cell, vec, own): a row for the home cell and for each probe in every table."""

    def run(batches):
        for batch in batches:
            vec = np.asarray(batch.column(0))
            for at, x in _stacks(_raw(batch.column(1))):
                for a in range(0, len(at), 1024):
                    cells = cells_of(x[a : a + 1024], lattice)
                    k = cells.shape[1] * cells.shape[2]
                    own = np.zeros(cells.shape, dtype=bool)
                    own[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cells.ravel().view(np.int64)),
                            pa.array(np.repeat(vec[at[a : a + 1024]], k)),
                            pa.array(own.ravel()),
                        ],
                        names=["cell", "vec", "own"],
                    )

    return reps.select("vec", "embedding").mapInArrow(run, "cell long, vec long, own boolean")


def _forest(p: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
    """Positions of links that make a spanning forest."""
    parent = list(range(size))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(p.tolist(), q.tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[b] = a
            kept.append(k)
            if len(kept) + 1 == size:
                break
    return np.array(kept, dtype=np.int64)


def _pairs(starts: np.ndarray, sizes: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions p < q of the vectors of one group with a cosine of ``least`` or more."""
    p_, q_ = [], []
    small = sizes <= 32
    width = np.repeat(np.where(small, sizes, 0), sizes)
    p = np.repeat(np.arange(len(x)), width)
    q = np.repeat(np.repeat(starts, sizes), width) + np.arange(len(p)) - np.repeat(np.cumsum(width) - width, width)
    p, q = p[p < q], q[p < q]
    for a in range(0, len(p), 100_000):
        i, j = p[a : a + 100_000], q[a : a + 100_000]
        hit = (x[i] * x[j]).sum(axis=1) >= least
        p_.append(i[hit])
        q_.append(j[hit])
    for start, size in zip(starts[~small], sizes[~small]):
        group = x[start : start + size]
        for a in range(0, size, 256):
            i, j = np.nonzero(group[a : a + 256] @ group.T >= least)
            i += a
            p_.append(start + i[i < j])
            q_.append(start + j[i < j])
    return np.concatenate(p_) if p_ else np.zeros(0, np.int64), np.concatenate(q_) if q_ else np.zeros(0, np.int64)


def _first_meeting(cells: np.ndarray, here: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the pairs (p with the smaller id) meet first in the cell ``here``.

    Meetings are ordered by table, and within a table the home cell of p comes first.
    """
    first = np.ones(len(p), dtype=bool)
    for a in range(0, len(p), 100_000):
        some = slice(a, a + 100_000)
        cp, cq, h = cells[p[some]], cells[q[some]], here[some]
        table = np.argmax((cp == h[:, None, None]).any(axis=2), axis=1)
        ok = np.ones(len(h), dtype=bool)
        for t in range(cells.shape[1]):
            at_p = (cp[:, t, :1] == cq[:, t]).any(axis=1)
            at_q = (cq[:, t, :1] == cp[:, t]).any(axis=1)
            ok &= ~((table > t) & (at_p | at_q))
            ok &= ~((table == t) & (cp[:, t, 0] != h) & at_p)
        first[some] = ok
    return first


def _compared(rows: DataFrame, lattice: Lattice, least: float) -> DataFrame:
    """Per comparison: (a, null, others linked with a) and forest links (a, b, null).

    The rows of a comparison lie together; several are worked on at once.
    """

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, i, j, chunk, vec, size = (
            table.column(c).to_numpy() for c in ("cell", "i", "j", "chunk", "vec", "size")
        )
        own = table.column("own").to_numpy()
        raw = table.column("raw").to_pylist()
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        new = np.ones(len(cell), dtype=bool)
        new[1:] = (np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        group = np.cumsum(new)
        for length in np.unique(lengths):  # a cell holds vectors of one length
            at = np.flatnonzero(lengths == length)
            x = _units([raw[k] for k in at])
            starts = np.flatnonzero(np.append(True, np.diff(group[at]) != 0))
            sizes = np.diff(np.append(starts, len(at)))
            p, q = (at[k] for k in _pairs(starts, sizes, x, least))
            fine = (own[p] | own[q]) & (vec[p] != vec[q]) & ((i[p] == j[p]) | (chunk[p] != chunk[q]))
            p, q = p[fine], q[fine]
            if not len(p):
                continue
            p, q = np.where(vec[p] < vec[q], p, q), np.where(vec[p] < vec[q], q, p)
            ids, one = np.unique(vec[np.concatenate([p, q])], return_index=True)
            one = np.concatenate([p, q])[one]
            a, b = np.searchsorted(ids, vec[p]), np.searchsorted(ids, vec[q])
            cells = np.concatenate(
                [cells_of(_units([raw[k] for k in one[s : s + 1024]]), lattice) for s in range(0, len(one), 1024)]
            )
            first = _first_meeting(cells, cell[p].view(np.uint64), a, b)
            a, b, p, q = a[first], b[first], p[first], q[first]
            links = np.bincount(a, size[q], len(ids)) + np.bincount(b, size[p], len(ids))
            some = np.flatnonzero(links)
            tree = _forest(a, b, len(ids))
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[some], ids[a[tree]]])),
                    pa.concat_arrays([none, pa.array(ids[b[tree]], pa.int64())]),
                    pa.concat_arrays([pa.array(links[some].astype(np.int64)), pa.nulls(len(tree), pa.int64())]),
                ],
                names=["a", "b", "n"],
            )

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 30_000:
                continue
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in ("cell", "i", "j")]
            last = np.ones(len(table), dtype=bool)
            for k in keys:
                last &= k == k[-1]
            cut = int(len(table) - last.sum())  # the last comparison may go on in the next batch
            if cut:
                yield from work(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield from work(pa.Table.from_batches(held))

    together = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "vec")
    return together.mapInArrow(run, "a long, b long, n long")


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = 0.9, lattice: Lattice | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``df``."""
    df = df.select(F.col(id_col).cast("long").alias("vec"), F.col(vector).alias("embedding"))
    keyed = staged(_keyed(df))
    classes = staged(
        keyed.where("same IS NOT NULL").groupBy("same").agg(F.min("vec").alias("rep"), F.count(F.lit(1)).alias("size"))
    )
    members = staged(keyed.join(classes, "same", "left").select("vec", F.coalesce("rep", "vec").alias("rep"), "size"))
    reps = df.join(classes.select(F.col("rep").alias("vec"), "size"), "vec").dropDuplicates(["vec"])
    reps = staged(reps)
    if lattice is None:
        lengths = [r[0] for r in reps.select(F.size("embedding")).distinct().collect()]
        lattice = lattice_for(classes.count(), least, measured_dims(lengths))
    raw = _with_raw(reps)
    filed = staged(_filed(reps, lattice))
    met = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("own").alias("any_own"))
    met = met.where("rows > 1 AND any_own").select("cell", F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"))
    rows = filed.join(met, "cell").join(raw, "vec")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("vec"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    rows = rows.select("cell", "i", "j", "chunk", "vec", "own", "size", "raw")
    found = staged(_compared(rows, lattice, least))
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    label = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    out = members.join(counts, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(
        F.col("vec").alias("vec_id"),
        (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
