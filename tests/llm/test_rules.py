"""URL rules, quality rules, quality model, license scan, the pipeline and the SQL queries."""

import math
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stubble.llm import license_scan, quality_model, quality_rules, queries, url_rules
from tests.compare import compare, connect, plan_of
from tests.llm.fixtures import documents, empty, labels, rows

SF_DIR = "/root/testdata/sf0.001"
NATIVE = ("op1_balanced_shards", "op3_url_filter", "op5_quality_rules")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    assert compare(queries.QUERIES[name](spark, SF_DIR), queries.ORACLES[name], connect(SF_DIR)) is None


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, SF_DIR))
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


URLS = [
    None,
    "",
    "no scheme.org/x",
    "http://Example.ORG/es/1?q",
    "https://www.example.org/es/",
    "https://www.example.org/es",
    "https://notexample.org/en/123#top",
    "https://example.org/en/123#top",
    "https://a.b.example.org/en/1",
    "http://x.com/fr/",
    "http://x.com/de/x",
    "http://xcom/de/x",
    "http://org/",
    "http://org",
    "http://spam-farm.example.net/a",
    "http://q/?u=http://spam-farm.example.org/",
    "ftp://h://x/y",
    "http://x.com/fr/\nline",
    "http://x.com/fr/é",
]


def judged_by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = None
    for r in queries.URL_RULES:
        if not r.rank:
            continue
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = r if best is None or len(r.name) > len(best.name) else best
    if best:
        return host, path, best.name, best.action
    block = any(not r.rank and re.search(r.pattern, host + path) for r in queries.URL_RULES)
    return host, path, None, "block" if block else "allow"


def test_urls_by_hand(spark):
    data = [(i, u, "clash", "clash", "clash") for i, u in enumerate([*URLS, URLS[3], None])]
    df = spark.createDataFrame(data, "page_id long, url string, target string, rule_at string, host string")
    got = url_rules.judge_urls(df, queries.URL_RULES).collect()
    assert len(got) == len(data)
    for r in got:
        host, path, rule, verdict = judged_by_hand(r["url"])
        mine = queries.URL_RULES[r["rule_at"]] if r["rule_at"] is not None else None
        assert (r["host"], r["path"], r["verdict"]) == (host, path, verdict), r
        assert (mine.name if mine and mine.rank else None) == rule


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert url_rules.judge_urls(df, []).first()["verdict"] == "allow"
    assert url_rules.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_a_rule_is_filed_under_its_rarest_token(spark):
    urls = spark.createDataFrame([(f"example.org/es/{i}",) for i in range(3)] + [("example.org/x",)], "target string")
    index = url_rules.rule_index(urls, [url_rules.site_rule("example.org/es/", "block")]).collect()
    assert [r["token"] for r in index] == ["es"]


def counts_by_hand(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    repeated = set()
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    for i, w in enumerate(windows):
        if seen[w] > 1:
            repeated.update(range(i, i + 8))
    earlier, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in earlier
            earlier.add(line)
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated)


def test_base_counts_by_hand(spark):
    got = quality_rules.measured(documents(spark)).withColumn("failed", quality_rules.base_failed()).collect()
    assert len(got) == len(rows())
    for r in got:
        want = counts_by_hand(r["text"])
        assert tuple(r[c] for c in quality_rules.BASE) == want
        assert r["failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 7, 50, 400, 30_000) for k in (0, 1, 3, 20, 100) if k <= n]
    df = spark.createDataFrame(cases, "n long, k long")
    for p in (0.005, 0.05):
        for r in df.select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), p).alias("t")).collect():
            n, k = r["n"], r["k"]
            if k >= n * p:
                assert r["t"] == 1.0
                continue
            logs = [
                math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
                for i in range(k + 1)
            ]
            assert r["t"] == pytest.approx(sum(map(math.exp, logs)), rel=1e-6)


def test_certified_cutoffs_hold_the_risk(spark):
    """Clean documents in two strata, junk among them; the junk goes, the good stay."""
    rng = random.Random(4)
    data, known = [], []
    for i in range(3000):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)]
        junk = i % 10 == 0
        if junk:
            words = [w + "$$$$$" for w in words]
        data.append((i, " ".join(words), "en" if i % 2 else None, "s", 0, None))
        known.append((i, 0 if junk else 1, 0))
    docs = documents(spark, data)
    features = quality_rules.measured(docs).drop("text")
    cutoffs = quality_rules.certified_cutoffs(features, labels(spark, known), "lang")
    got = quality_rules.with_verdict(features, cutoffs, "lang").collect()
    assert all(r["kept"] == (r["doc_id"] % 10 != 0) for r in got)
    few = quality_rules.certified_cutoffs(features, labels(spark, known[:40]), "lang")
    assert quality_rules.with_verdict(features, few, "lang").where("kept").count() == 3000  # nothing is sure


def test_quality_rules_without_labels_or_rows(spark):
    features = quality_rules.measured(documents(spark)).drop("text")
    none = quality_rules.certified_cutoffs(features, labels(spark, []), "lang")
    got = quality_rules.with_verdict(features, none, "lang").collect()
    assert len(got) == len(rows()) and all(r["kept"] != r["base_failed"] for r in got)
    nothing = quality_rules.measured(empty(spark)).drop("text")
    assert quality_rules.with_verdict(nothing, none, "lang").count() == 0


def test_model_learns_and_leaves_held_out_labels_alone(spark):
    rng = random.Random(8)
    data, known = [], []
    for i in range(900):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
        bad = i % 3 == 0
        if bad and i % 2:
            words = [w.upper() for w in words]
        elif bad:
            words = [words[0]] * 40
        data.append((i, " ".join(words), None, None, 0, None))
        known.append((i, 0 if bad else 1, 0))
    docs = documents(spark, data)
    got = quality_model.judged(docs, labels(spark, known)).collect()
    held = [r for r in got if r["held_out"]]
    assert 200 < len(held) < 400
    assert sum(r["predicted"] == (r["doc_id"] % 3 != 0) for r in held) >= 0.97 * len(held)
    # Other labels of held-out documents change no score.
    out = {r["doc_id"] for r in held}
    turned = [(i, 1 - q if i in out else q, t) for i, q, t in known]
    again = {r["doc_id"]: r["score"] for r in quality_model.judged(docs, labels(spark, turned)).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in got)


def test_model_on_odd_rows(spark):
    got = quality_model.judged(documents(spark), labels(spark)).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_model.judged(documents(spark), labels(spark, [])).collect()} == {0.5}
    assert quality_model.judged(empty(spark), labels(spark)).count() == 0


def test_interactions_are_learnt():
    rng = quality_model.np.random.default_rng(3)
    x = rng.random((4000, len(quality_model.MEASURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no measure alone tells
    model = quality_model.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() > 0.9


def places_by_hand(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
    found = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        found += [(label, i) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_license_places_by_hand(spark):
    texts = documents(spark).select("doc_id", "text")
    for r in license_scan.scan_licenses(documents(spark)).join(texts, "doc_id").collect():
        assert (r["n_words"], sorted((p["label"], p["word"]) for p in r["places"])) == places_by_hand(r["text"])
    assert license_scan.scan_licenses(empty(spark)).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
        ("Released under the MIT License.", ["mit"]),
        ("GNU Lesser General Public License version 2.1 or any later version", ["lgpl-2.1-or-later"]),
        ("SPDX-License-Identifier: GPL-3.0-only", ["gpl-3.0"]),
        ("CC BY-NC-SA 4.0", ["cc-by-nc-sa-4.0"]),
        ("Creative Commons Attribution-ShareAlike 3.0", ["cc-by-sa-3.0"]),
        ("the 3-clause BSD license", ["bsd-3-clause"]),
        ("the licence of a driver, released publicly", []),
        ("", []),
    ],
)
def test_license_rules(text, want):
    _, _, spans = license_scan.scanner(license_scan.default_rules()).scan(text.encode())
    assert [s[0] for s in spans] == want


def made_match(parsed, rng):
    """A random text that the parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "SUBPATTERN":
            out += made_match(arg[3], rng)
        elif op == "BRANCH":
            out += made_match(rng.choice(arg[1]), rng)
        elif op == "MAX_REPEAT":
            least, most, part = arg
            out += "".join(made_match(part, rng) for _ in range(rng.randint(least, min(most, least + 3))))
        elif op == "IN":
            kind, value = rng.choice(arg)
            out += chr(value) if str(kind) == "LITERAL" else "7" if "DIGIT" in str(value) else "x"
    return out


def test_the_keyword_gate_passes_every_match():
    rng = random.Random(1)
    for rule in license_scan.default_rules():
        parsed = re._parser.parse(rule.pattern)
        for _ in range(40):
            text = made_match(parsed, rng)
            assert re.search(rule.pattern, f" {text} "), (rule.pattern, text)
            assert set(rule.keywords) <= set(text.split()), (rule.pattern, rule.keywords, text)


@pytest.mark.parametrize(
    "text, want",
    [("GPL3", "gpl-3.0"), ("AGPL3", "agpl-3.0"), ("Apache2.0", "apache-2.0"), ("MPL2.0", "mpl-2.0"), ("PHP licence", "php")],
)
def test_labels_of_joined_spellings(text, want):
    spans = license_scan.scanner(license_scan.default_rules()).scan(text.encode())[2]
    assert want in [s[0] for s in spans]


def test_license_rules_number_hundreds():
    rules = license_scan.default_rules()
    assert len(rules) > 300 and len({r.label for r in rules}) > 100
    for r in rules:  # a keyword is a word of the pattern or of one of its readings
        assert re.compile(r.pattern)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    documents(spark).write.parquet(f"{folder}/documents.parquet")
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{k}")
        was, docs = docs, spark.read.parquet(f"{folder}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.subtract(was).count() == 0
        if k == 0:
            want = {r[0] for r in rows()} - {
                r[0] for r in rows() if (c := counts_by_hand(r[1]))[0] < 20 or 100 * c[4] > 30 * c[0]
            }
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
    kept = [r["doc_id"] for r in spark.read.parquet(f"{folder}/2").select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and 7 in kept
    assert not {8, 9, 11, 12} & set(kept)  # copies of 7
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == set(kept)


def test_pipeline_on_empty_tables(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_queries_are_registered():
    import __spark_entry__ as entry_point

    names = entry_point.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


def slow_scan(scan, text):
    """Detections with suppression by looking at every standing one."""
    words = license_scan.words_of(text)
    body = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogateescape")
    found = []
    for rule, pattern, keys in [e for filed in scan.filed.values() for e in filed] + scan.always:
        found += [(m.start(), m.end(), rule) for m in pattern.finditer(body)]
    standing = []
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        if not any(a <= start and end <= b for a, b, _ in standing):
            standing.append((start, end, rule))
    standing.sort(key=lambda d: (d[0], d[1], d[2].label))
    spans = [(r.label, body.count(" ", 0, a) - 1, body.count(" ", 0, b) - 1, r.weight) for a, b, r in standing]
    joined = b" " + b" ".join(words) + b" "
    base = []
    for phrase, label in scan.base:
        at = joined.find(phrase)
        while at >= 0:
            base.append((label, joined.count(b" ", 0, at)))
            at = joined.find(phrase, at + 1)
    return len(words), base, spans


def test_gated_scans_equal_slow_scans_of_all_rules():
    scan = license_scan.scanner(license_scan.default_rules())
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()
    texts = [t.encode() for (t,) in texts if len(t) < 20_000]
    rng = random.Random(2)
    pieces = "gnu general public license version 2 or later|cc by sa 4 0|cc by x|all rights reserved|apache license version 2 0|mit license|İ é 日本|gpl3|the 3 clause bsd license|spdx license identifier mit".split("|")
    texts += [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))).encode() for _ in range(200)]
    for text in texts:
        assert scan.scan(text) == slow_scan(scan, text)


def test_a_megabyte_of_matches_is_scanned_in_seconds():
    scan = license_scan.scanner(license_scan.default_rules())
    began = time.process_time()
    words, base, spans = scan.scan(b"cc by x " * 131_072)
    assert time.process_time() - began < 5
    assert words == 3 * 131_072 and len(base) == 131_072 and len(spans) == 131_072
