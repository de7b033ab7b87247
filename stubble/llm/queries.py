"""The driver queries over the operators of this folder, each with its SQL where there is one."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stubble.llm import (
    bpe_stream,
    direct_codes,
    lattice_dedup,
    license_scan,
    ngram_join,
    packing,
    prefix_trie,
    quality_model,
    quality_rules,
    ranked_search,
    sharding,
    token_counts,
    url_rules,
)
from stubble.llm.common import read
from stubble.llm.registry import ORACLES, QUERIES, query
from stubble.operators.staging import staging_root

__all__ = ["ORACLES", "QUERIES"]

SHARDS = 24


@query()
def op1_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards, equal texts together, counts at most one apart."""
    body = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("same_text"),
    )
    order = ["doc_id", "text_crc32", "size"]
    out = sharding.balanced_shards(docs, ["same_text"], SHARDS, order)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: What the URL filter judges by: site rules first, then patterns of unwanted pages.
URL_RULES = [
    url_rules.site_rule("org/", "allow"),
    url_rules.site_rule("example.org/es/", "block"),
    url_rules.site_rule("example.org/en/1", "block"),
    url_rules.site_rule("com/fr/", "allow"),
    url_rules.site_rule("com/de/", "block"),
    url_rules.UrlRule("spam-farm", "block", r"(^|\.)spam-farm\.", ("spam", "farm")),
    url_rules.UrlRule("cheap-pills", "block", r"(^|\.)cheap-pills\.", ("cheap", "pills")),
    url_rules.UrlRule("casino", "block", r"(^|[.-])casino[.-]", ("casino",)),
    url_rules.UrlRule("login-form", "block", r"^[^/]*/(.*/)?login(/|$)", ("login",)),
    url_rules.UrlRule("archive-file", "block", r"^[^/]*/.*[.](zip|exe)$", ()),
]

OP3_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages), j AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
      WHEN ('.' || host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
      WHEN ('.' || host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
      WHEN ('.' || host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, '(^|\.)spam-farm\.') THEN 'block'
    WHEN regexp_matches(host || path, '(^|\.)cheap-pills\.') THEN 'block'
    WHEN regexp_matches(host || path, '(^|[.-])casino[.-]') THEN 'block'
    WHEN regexp_matches(host || path, '^[^/]*/(.*/)?login(/|$)') THEN 'block'
    WHEN regexp_matches(host || path, '^[^/]*/.*[.](zip|exe)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM j"""


@query(OP3_SQL)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, the longest site rule and the verdict of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge_urls(pages, URL_RULES)
    site = F.array(*[F.lit(r.name) if r.rank else F.lit(None).cast("string") for r in URL_RULES])
    return judged.select("page_id", "host", "path", F.get(site, "rule_at").alias("rule"), "verdict")


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether the certified rules keep it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_decisions(docs, read(spark, sf_dir, "labels")).select(
        "doc_id", *quality_rules.BASE, "base_failed", "kept"
    )


def quality_decisions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures, base_failed and kept per document, without the texts."""
    features = quality_rules.staged(quality_rules.measured(docs).drop("text"))
    cutoffs = quality_rules.certified_cutoffs(features, labels, "lang")
    return quality_rules.with_verdict(features, cutoffs, "lang")


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and whether they exceed 2048."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    counted = token_counts.with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query()
def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of the text decoded from them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_stream.with_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


@query()
def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS gs FROM w),
s AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS gram FROM g),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s AS a JOIN s AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r(x, c) AS (SELECT doc_id, doc_id FROM g UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x),
m AS (SELECT x, min(c) AS c FROM r GROUP BY x)
SELECT doc_id, CAST(len(gs) AS BIGINT) AS n_shingles, c AS component_id FROM g JOIN m ON x = doc_id"""


@query(OP4_SQL)
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and similarity component of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.similarity_components(docs)


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, len(e) AS d FROM v WHERE e IS NOT NULL AND list_sum(list_transform(e, lambda x: x * x)) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id AND a.d = b.d
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(x, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT k.y, r.c FROM r JOIN k ON k.x = r.x),
m AS (SELECT x, min(c) AS c FROM r GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM k WHERE k.x = vec_id) AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN m ON m.x = vec_id"""


@query(OP10_SQL)
def op10_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding at a cosine of 0.9 or more."""
    return lattice_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query()
def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_model.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and confidence of every document."""
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.transform("places", lambda p: p["label"])
    words = F.transform("places", lambda p: p["word"])
    named = F.transform("detections", lambda d: d["label"])
    doubt = F.aggregate("detections", F.lit(1.0), lambda a, d: a * (1.0 - d["weight"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, named)), ",").alias("labels"),
        (1.0 - doubt).alias("score"),
    )


@query()
def op13_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and digest of every document's ids, from the files they were written to."""
    folder = f"{staging_root(spark)}/token-files-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    direct_codes.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end=2)
    return direct_codes.read_documents(spark, folder)


_TERMS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP12_SQL = f"""
WITH t AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM t),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf
  FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM t) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE)
    / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term),
q AS (SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
r AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf)
    // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank,
  doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""


@query(OP12_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for every benchmark item."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.search(docs, read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, {'role': role, 'text': text} AS t, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role, sha256(length(role) || ' ' || role || ' ' || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, list(t ORDER BY pos) AS ts FROM t GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    flatten([[CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
      FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
      ELSE xor(a // 2, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END,
    CAST(4294967295 AS BIGINT))) % 4 AS h FROM c),
b AS (SELECT h.conv_id, list_concat(coalesce(list_slice(o.ts, 1, h.h), []),
    list_slice(h.ts, h.h + 1, len(h.ts))) AS s FROM h LEFT JOIN c AS o ON o.conv_id = h.base),
m AS (SELECT conv_id, len(s) AS size, d, list_slice(s, 1, d) AS path
  FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM b)),
n AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '') AS ends,
    coalesce(len(list_filter(regexp_split_to_array(any_value(path[d].text), '[\x20\x09-\x0D]+'),
      lambda x: x <> '')), 0) AS words
  FROM m GROUP BY path),
k AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children
  FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.path = k.path),
s AS (SELECT list_slice(path, 1, d) AS path, sum((n_convs - 1) * words) AS saved,
    count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON f.path = s.path
LEFT JOIN n AS p ON f.depth > 0 AND p.path = list_slice(f.path, 1, f.depth - 1)"""


@query(OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations rebuilt from heads of others and their own rest."""
    conv = F.col("conv")
    heads = F.crc32(F.encode(conv.cast("string"), "UTF-8")) % 4
    trie = prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"), conv - conv % 20, heads)
    return trie.drop("turn_conv_id", "turn_place")
