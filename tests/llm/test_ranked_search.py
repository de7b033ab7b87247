"""Ranked search against scoring every document, and against SQL."""

import math
import re

import numpy as np
import pytest

from stubble.llm import ranked_search
from stubble.llm.queries import OP12_SQL, op12_ranked_search
from tests.compare import compare, connect
from tests.llm import fixtures

SF_DIR = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """``(item, rank, doc, score)`` by scoring every document, in integers."""
    split = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(1 for _, t in split if t), sum(len(t) for _, t in split)
    df = {}
    for _, words in split:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, words in split:
            score = 0
            for term in terms(text):
                if tf := words.count(term):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 100 - 75 + 75 * len(words) * n_docs // total
                    score += w * (1000000000 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1):
            out.append((item, rank, doc, -score))
    return out


def ordered(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: tuple((v is not None, v or 0) for v in r))


@pytest.mark.parametrize("docs_in_block", [3, 16_384])
def test_equals_scoring_every_document(spark, monkeypatch, docs_in_block):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", docs_in_block)
    monkeypatch.setattr(ranked_search, "CHUNK", 2)
    rows = fixtures.rows() + [(None, "two words without an id", "en", "s", 5, "x")] * 2
    texts = fixtures.texts()
    items = [(1, texts[7]), (2, "two words TWO"), (3, None), (4, "…,.;"), (5, "unheardof zzzq"), (None, "again and lines")]
    items += [(6, " ".join(texts[20 + i] or "" for i in range(6))), (7, "日本語 don't é́")]
    queries = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    found = ranked_search.search(fixtures.documents(spark, rows), queries, 4)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert ordered(found.collect()) == ordered(brute([(r[0], r[1]) for r in rows], items, 4))


def test_crowded_bitmaps_only_let_more_through(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BITMAP", 2)
    items = [(1, "two words"), (2, fixtures.texts()[7])]
    queries = spark.createDataFrame(items, "item_id long, text string")
    found = ranked_search.search(fixtures.documents(spark), queries, 10)
    assert ordered(found.collect()) == ordered(brute([(r[0], r[1]) for r in fixtures.rows()], items, 10))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    assert ranked_search.search(fixtures.documents(spark), none).collect() == []
    assert ranked_search.search(fixtures.empty(spark), some).collect() == []


def random_lists(rng, lists, docs):
    out = []
    for _ in range(lists):
        members = rng.permutation(docs)[: rng.integers(1, docs + 1)]
        values = rng.integers(1, 40, len(members)) ** 3
        order = np.lexsort((members, -values))
        out.append((members[order], values[order]))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_best_positions_equal_all_scores_and_ties_go_to_the_lower_document(seed):
    rng = np.random.default_rng(seed)
    docs, k = int(rng.integers(1, 3000)), int(rng.integers(1, 12))
    lists = random_lists(rng, int(rng.integers(1, 6)), docs)
    total = np.zeros(docs, dtype=np.int64)
    for members, values in lists:
        total[members] += values
    want = [int(d) for d in np.lexsort((np.arange(docs), -total)) if total[d] > 0][:k]
    found, scores, _ = ranked_search.best_positions(lists, docs, k)
    assert found.tolist() == want
    assert scores.tolist() == total[want].tolist()


def test_reading_stops_long_before_the_lists_end():
    rng = np.random.default_rng(1)
    values = np.sort((rng.pareto(1.0, (2, 100_000)) * 1000).astype(np.int64) + 1)[:, ::-1]
    lists = [(rng.permutation(100_000), v) for v in values]
    assert ranked_search.best_positions(lists, 100_000, 10)[2] < 20_000


def test_equal_scores_are_not_lost_when_reading_could_stop():
    # All documents score alike: the bound never falls below the best, so the lowest are found.
    members = np.arange(500)[::-1].copy()
    lists = [(members, np.full(500, 7)), (members, np.full(500, 9))]
    assert ranked_search.best_positions(lists, 500, 3)[0].tolist() == [0, 1, 2]


def test_query_agrees_with_sql(spark):
    assert compare(op12_ranked_search(spark, SF_DIR), OP12_SQL, connect(SF_DIR)) is None
