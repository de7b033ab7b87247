"""Near duplicates of texts and of vectors against all pairs, and sharding."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stubble.llm import lattice_dedup, ngram_join, sharding
from stubble.llm.components import connected_components
from stubble.operators import staging
from tests.llm.fixtures import documents, empty, rows


def word_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in ids}


def brute(data):
    sets = {r[0]: word_set(r[1]) for r in data}

    def linked(a, b):
        n = len(sets[a] & sets[b])
        return n > 0 and 100 * n >= 75 * len(sets[a] | sets[b])

    found = components(list(sets), linked)
    return sorted((r[0], len(sets[r[0]]), found[r[0]]) for r in data)


def test_ngram_join_equals_all_pairs(spark):
    got = ngram_join.similarity_components(documents(spark))
    assert sorted(map(tuple, got.collect())) == brute(rows())


def test_ngram_join_leaves_no_table_that_is_read_no_more(spark):
    begin = len(staging._MADE)
    got = ngram_join.similarity_components(documents(spark))
    left = [spark.read.parquet(path).columns for path in staging._MADE[begin:]]
    assert not [c for c in left if {"bits", "tokens", "leader"} & set(c) or c == ["token", "node"]]
    assert sorted(map(tuple, got.collect())) == brute(rows())


@pytest.mark.parametrize("own,inside", [("10000", "2500"), ("0", "2500"), ("100", "100")])
def test_ngram_join_takes_small_arrow_batches(spark, monkeypatch, own, inside):
    name, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", set(), ngram_join.staged

    def watched(df):
        seen.add(spark.conf.get(name))
        return plain(df)

    monkeypatch.setattr(ngram_join, "staged", watched)
    before = spark.conf.get(name)
    spark.conf.set(name, own)
    try:
        ngram_join.similarity_components(empty(spark))
        assert (seen, spark.conf.get(name)) == ({inside}, own)
    finally:
        spark.conf.set(name, before)


def test_chains_and_blocks_beyond_a_chunk(spark, monkeypatch):
    """Copies that drift apart: no star joins them, and blocks need several trees."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    data = []
    for i in range(90):
        words = list(words)
        words[int(rng.integers(60))] = f"n{i}"
        data.append((i, " ".join(words), None, None, 0, None))
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    got = ngram_join.similarity_components(documents(spark, data))
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(104)]
    data = [(0, " ".join(words), None, None, 0, None)]
    for k in range(1, 30):  # k words less at the end: 100 - k of 100 shingles are common
        data.append((k, " ".join(words[: 104 - k]), None, None, 0, None))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(documents(spark, data)).collect()}
    want = {i: c for i, _, c in brute(data)}
    assert got == want
    pair = documents(spark, [data[0], data[25]]), documents(spark, [data[0], data[26]])
    assert [ngram_join.similarity_components(p).where("doc_id <> component_id").count() for p in pair] == [1, 0]


def test_tree_bounds_lose_no_pair():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        for _ in range(3):
            some = base[rng.random(200) > rng.random() * 0.3]
            sets.append(np.unique(np.concatenate([some, rng.integers(0, 1 << 63, 10).astype(np.uint64)])))
    maps = [ngram_join.bitmap(s) for s in sets]
    bits = np.array([ngram_join.folded(m, ngram_join.BITS) for m in maps]).view(np.uint64)
    n = np.array([len(s) for s in sets])
    tree = ngram_join.SignatureTree(bits, n, np.arange(len(sets)))
    i, j = ngram_join.dual_traversal(tree, tree, 75)
    found = set(zip(i.tolist(), j.tolist()))
    links = {(a, b) for a in range(len(sets)) for b in range(len(sets)) if a != b and ngram_join.linked(sets[a], sets[b], 75)}
    assert links and links <= found and len(found) < len(sets) ** 2 / 4
    assert all(ngram_join.may_link(maps[a], len(sets[a]), maps[b], len(sets[b]), 75) for a, b in links)
    long = [rng.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(2)]
    long = [np.unique(x) for x in (long[0], long[1], np.concatenate([long[0][:18_000], long[1][:1_000]]))]
    wide = [ngram_join.bitmap(x) for x in long]
    assert not ngram_join.may_link(wide[0], len(long[0]), wide[1], len(long[1]), 75)
    assert ngram_join.may_link(wide[0], len(long[0]), wide[2], len(long[2]), 75)


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(empty(spark, "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, own string"


def planted(n=600, dim=64, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(0, n // 2, 3):  # pairs between 0.9 and 1, and a crowd
        noise = rng.normal(size=dim)
        noise -= noise @ x[k] * x[k]
        cos = rng.uniform(0.93, 0.999)
        x[k + 1] = cos * x[k] + np.sqrt(1 - cos * cos) * noise / np.linalg.norm(noise)
    crowd = x[-1] + rng.normal(size=(120, dim)) * 0.012
    return np.concatenate([x, crowd]).astype(np.float32)


def test_lattice_links(spark):
    x = planted()
    data = [(i, v.tolist(), 0, "clash") for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in lattice_dedup.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= close.sum(axis=1)).all()  # nothing counted twice, nothing below
    assert found.sum() >= 0.9 * close.sum()
    for i, r in got.items():
        assert r["kept"] == (r["component_id"] == i) and r["component_id"] <= i


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    data = [
        (0, None, 0, ""),
        (1, [], 0, ""),
        (2, [0.0, 0.0, 0.0], 0, ""),
        (3, [1.0, None, 2.0], 0, ""),
        (4, [1.0, float("nan"), 2.0], 0, ""),
        (5, [float("inf"), 1.0, 2.0], 0, ""),
        (6, one, 0, ""),
        (7, one, 0, ""),
        (8, [2.0, 4.0, 6.0], 0, ""),
        (9, [1.0, 2.0], 0, ""),
        (10, [-1.0, -2.0, -3.0], 0, ""),
    ]
    got = lattice_dedup.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()
    links = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert links == {**{i: (0, i) for i in (0, 1, 2, 3, 4, 5, 9, 10)}, 6: (2, 6), 7: (2, 6), 8: (2, 6)}
    assert lattice_dedup.near_duplicates(empty(spark, VECTORS)).count() == 0


def test_crowds_beyond_a_chunk_count_alike(spark, monkeypatch):
    data = [(i, v.tolist(), 0, "") for i, v in enumerate(planted(90))]
    df = spark.createDataFrame(data, VECTORS)
    whole = sorted(map(tuple, lattice_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(lattice_dedup, "CHUNK", 16)
    assert sorted(map(tuple, lattice_dedup.near_duplicates(df).collect())) == whole


@pytest.mark.parametrize("vectors", [500, 5_000, 51_000, 500_000, 3_000_000, 30_000_000])
def test_lattice_recall_at_the_threshold(vectors):
    for dim in (24, 64):
        lattice = lattice_dedup.lattice_for(vectors, 0.9, lattice_dedup.measured_dims([dim]))
        for cosine in (0.9, 0.91, 0.92):
            pairs = lattice_dedup.made_pairs(600, dim, cosine, 99)
            assert lattice_dedup.meetings(*pairs, lattice).any(axis=1).mean() >= 0.9


def test_lattice_links_just_above_the_threshold(spark):
    a, b = lattice_dedup.made_pairs(1500, 64, 0.905, 5)
    data = [(i, v.tolist(), 0, "") for i, v in enumerate([*a, *b])]
    got = {r["vec_id"]: r for r in lattice_dedup.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()}
    assert sum(got[i]["component_id"] == got[i + 1500]["component_id"] for i in range(1500)) >= 1350


def test_nearest_lattice_points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * 2
    near = lattice_dedup.nearest_e8(x)
    away = ((x - near) ** 2).sum(axis=1)
    twice = np.rint(2 * near).astype(int)
    assert (twice == 2 * near).all()
    assert ((twice % 2 == 0).all(axis=1) | (twice % 2 != 0).all(axis=1)).all()
    assert (near.sum(axis=1) % 2 == 0).all()
    for root in lattice_dedup.roots():  # no neighbour is nearer
        assert (((x - near - root) ** 2).sum(axis=1) >= away - 1e-9).all()


def shards_of(spark, df, n, **more):
    size = F.octet_length("text").alias("size")
    made = df.select("doc_id", F.col("text").alias("key"), size, F.lit("clash").alias("shard"))
    return sharding.balanced_shards(made, ["key"], n, ["doc_id", "size"], **more).collect()


def test_shards_are_even_and_keep_copies_together(spark):
    data = [(i, f"t{i // 4}" if i < 80 else f"t{i}", None, None, 0, None) for i in range(300)]
    got = shards_of(spark, documents(spark, data), 7)
    sizes, together = {}, {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
        together.setdefault(r["key"], set()).add(r["shard"])
    assert len(got) == 300 and {len(s) for s in sizes.values()} == {42, 43}
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert all(len(s) == 1 for s in together.values())


@pytest.mark.parametrize("hot", [100, 300])
def test_a_hot_key_and_full_shards(spark, hot):
    data = [(i, "hot" if i < hot else f"t{i // 2}", None, None, 0, None) for i in range(300)]
    got = shards_of(spark, documents(spark, data), 8)
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 300 and {len(s) for s in sizes.values()} <= {37, 38}
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())


@pytest.mark.parametrize("sizes", [[150, 30, 28, 25, 22, 20, 20], [60, 37, 36, 35, 34, 33, 30, 20], [4] * 70])
def test_groups_that_fit_a_shard_stay_whole(spark, sizes):
    texts = [f"t{k}" for k, n in enumerate(sizes) for _ in range(n)]
    data = [(i, texts[i] if i < len(texts) else f"u{i}", None, None, 0, None) for i in range(300)]
    got = shards_of(spark, documents(spark, data), 8)
    held, together = {}, {}
    for r in got:
        held.setdefault(r["shard"], []).append(r["slot"])
        together.setdefault(r["key"], []).append(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    assert sum(map(len, held.values())) == 300 and {len(s) for s in held.values()} <= {37, 38}
    split = [len(shards) for shards in together.values() if len(shards) <= 38 and len(set(shards)) > 1]
    assert split == []


def test_groups_beyond_the_driver_find_other_shards(spark):
    groups = spark.createDataFrame([(i, 2, 0) for i in range(300)], "__lead long, n long, __to int")
    got = [r["shard"] for r in sharding._settled(groups, [150] * 4).collect()]
    assert len(got) == 300 and all(got.count(s) == 75 for s in range(4))


def test_shards_of_odd_rows(spark):
    got = shards_of(spark, documents(spark), 5)
    assert len(got) == len(rows())
    counts = [sum(r["shard"] == s for r in got) for s in range(5)]
    assert max(counts) - min(counts) <= 1
    assert shards_of(spark, empty(spark), 5) == []
    assert len(shards_of(spark, documents(spark, rows()[:2]), 5)) == 2


def test_quotas():
    moves = sharding.admitted({(0, 1): 5, (1, 0): 2, (2, 1): 1}, [10, 10, 10], [10, 11, 10])
    load = [10, 10, 10]
    for (a, b), n in moves.items():
        load[a] -= n
        load[b] += n
    assert load[0] <= 10 and load[1] <= 11 and load[2] <= 10 and sum(moves.values()) > 2


def test_checksums_are_unsigned(spark):
    text = "checksum"
    got = documents(spark, [(1, text, None, None, 0, None)]).select(F.crc32(F.encode("text", "UTF-8"))).first()[0]
    assert got == zlib.crc32(text.encode())


def test_rows_without_an_id_link_with_nothing(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w20", "x")
    data = [(None, text, None, None, 0, None), (None, near, None, None, 0, None), (4, text, None, None, 0, None), (9, near, None, None, 0, None)]
    data += [(None, None, None, None, None, None), (None, "lone words", None, None, 0, None)]
    got = ngram_join.similarity_components(documents(spark, data)).collect()
    known = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None)
    assert known == brute([r for r in data if r[0] is not None])
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None) == [(0, None), (1, None), (36, None), (36, None)]


@pytest.mark.parametrize("sketch", [16, 1])
def test_a_pair_that_meets_in_many_blocks_is_a_candidate_of_few(spark, sketch):
    """Unlike sets that no bitmap tells apart: none is lost, and with their lists none comes twice."""
    full = np.packbits(np.ones(ngram_join.BITS, dtype=np.uint8)).tobytes()
    members = [(token, node, node, 400, full, 40) for token in range(25) for node in range(40) if (node + token) % 3]
    table = spark.createDataFrame(members, "token long, node long, comp long, n long, bits binary, size int")
    lists = table.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("token")), 1, sketch).alias("tokens"))
    pairs = ngram_join._tree_pairs(ngram_join._with_chunks(table.join(lists, "node")), 75)
    got = sorted(map(tuple, pairs.collect()))
    want = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    assert sorted(set(got)) == want
    assert len(got) == len(want) or sketch == 1
