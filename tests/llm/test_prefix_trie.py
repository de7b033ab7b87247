"""Prefix trie against rebuilding every conversation, and against SQL."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stubble.llm import prefix_trie
from stubble.llm.queries import OP11_SQL, op11_prefix_trie
from tests.compare import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key long, h int"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def heads(conv):
    return zlib.crc32(str(conv).encode()) % 4


def brute(rows):
    """The nodes by rebuilding all sequences of turns."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn, role or "", text or ""))
    for conv, own in turns.items():
        digest = lambda t: hashlib.sha256(f"{len(t[1])} {t[1]} {t[2]}".encode()).hexdigest()
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], digest(t)))
        turns[conv] = [t[1:] for t in own]
    built = {}
    for conv, own in turns.items():
        base = conv - (conv % 20 if conv >= 0 else -(-conv % 20))
        built[conv] = tuple(turns.get(base, [])[: heads(conv)] + own[heads(conv) :])
    nodes = {}
    for conv, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(conv)
    out = []
    for path, convs in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        children = [p for p in below if len(p) == len(path) + 1]
        inner = {p[:-1] for p in nodes if p}
        ends = sorted(c for c in convs if built[c] == path)
        out.append(
            (
                min(convs),
                len(path),
                min(nodes[path[:-1]]) if path else None,
                len(convs),
                len(children),
                sum(p not in inner for p in below),
                sum((len(nodes[p]) - 1) * words(p) for p in below),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=lambda r: (r[0], r[1]))


def trie(spark, rows, **how):
    table = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)
    conv = F.col("conv")
    count = F.crc32(F.encode(conv.cast("string"), "UTF-8")) % 4
    return prefix_trie.prefix_trie(table, conv - conv % 20, count, **how)


def found(spark, rows, **how):
    got = trie(spark, rows, **how).select(*COLUMNS).collect()
    return sorted(map(tuple, got), key=lambda r: (r[0], r[1]))


def odd_rows():
    rng = random.Random(3)
    texts = [None, "", " ", "one", "two words", "a\tb\nc", "tail " * 40, "日本語 é"]
    rows = [(None, 1, "user", "belongs to none"), (None, None, None, None)]
    for conv in [*range(0, 70), -1, -7, -20, -25, 400, 403, 100_000]:
        shared = [(("user", "assistant")[i % 2], texts[i % 5]) for i in range(rng.randint(0, 6))]
        own = [(rng.choice(["user", None, "bot"]), rng.choice(texts)) for _ in range(rng.randint(0, 3))]
        rows += [(conv, i * 2, *t) for i, t in enumerate([*shared, *own])]
    rows += [(5, None, "system", "first"), (5, None, "system", "also first"), (5, None, None, "x"), (6, 2, "user", "tie"), (6, 2, "user", "tie")]
    rows += [(7, 0, "ab", "c"), (8, 0, "a", "bc")]
    rows += [(61, 100 + i, "user", f"turn {i % 3}") for i in range(90)]
    rng.shuffle(rows)
    return rows


def test_equals_rebuilding_every_conversation(spark):
    rows = odd_rows()
    assert found(spark, rows) == brute(rows)


def test_long_conversations_are_composed_from_many_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = [(0, i, "user", f"w {i}") for i in range(120)]
        # Two share all but their last turns with 0, one is a copy of 0 at every depth.
        rows += [(c, i, "user", f"w {i}" if i < 100 else f"{c} {i}") for c in (1, 2) for i in range(120)]
        rows += [(3, i, "user", f"w {i}") for i in range(120)]
        rows += [(c, i, "user", f"w {i}") for c in range(1000, 1030) for i in range(2)]
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_colliding_fingerprints_are_noticed_and_the_next_base_is_taken(spark):
    # With base 0 only the first turn counts: sequences of one length meet that differ behind it.
    rows = odd_rows()
    weak = (0, 0, 0)
    assert found(spark, rows, bases=(weak, prefix_trie.BASES[0])) == brute(rows)
    with pytest.raises(ValueError):
        trie(spark, rows, bases=(weak,))


def test_unlike_last_turns_of_one_fingerprint_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "turn_numbers", lambda digest: [F.length(digest).cast("long")] * prefix_trie.LANES)
    rows = [(1, 0, "user", "a"), (2, 0, "user", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError):
        prefix_trie.prefix_trie(table, F.col("conv"), F.lit(0))


def test_last_turns_refer_to_stored_turns(spark):
    rows = [(c, i, "user", f"{c if i else 0} {i}") for c in range(40) for i in range(5)]
    at = {}
    for conv, turn, _, text in rows:
        at[conv, turn + 1] = text
    for node in trie(spark, rows).collect():
        if node["depth"]:
            assert (node["turn_conv_id"], node["turn_place"]) in at
        else:
            assert node["turn_conv_id"] is None and node["parent_conv_id"] is None


def test_empty_table_and_turnless_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    turnless = next(c for c in range(1, 20) if heads(c) == 3)
    assert found(spark, [(turnless, 0, "user", "dropped")]) == brute([(turnless, 0, "user", "dropped")])


@pytest.mark.parametrize("n", [-5, -1, 0, 1, 2, 31, 4097, (1 << 31) - 2, 1 << 40])
def test_powers(spark, n):
    got = spark.range(1).select(prefix_trie.power(12345, F.lit(n).cast("long"))).first()[0]
    assert got == pow(12345, n, prefix_trie.PRIME)


def test_query_agrees_with_sql(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(op11_prefix_trie(spark, sf_dir), OP11_SQL, connect(sf_dir)) is None
