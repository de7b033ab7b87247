"""URL filter: pattern rules indexed by their rarest literal token.

Every rule names the literal tokens (runs of a-z and 0-9) that a matching URL must hold.
The tokens are counted over the URLs, each rule is filed under its rarest one, and the
tokens of a URL fetch the candidate rules. Only candidates run their regular expression.
Rules without a literal token are candidates of every URL.

Defined cases: a null URL or one without ``://`` has an empty host and path and matches
no rule that needs a token; equal URLs are judged once; an empty table or an empty rule
list gives no match; further columns of the input stay in ``judge_urls``, but for those with
the name of a result (host, path, rule_at, verdict), which are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stubble.llm.common import ascii_lower, rows_table
from stubble.operators.staging import staged


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is searched in host + path; a higher ``rank`` wins, then the longer name."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    rank: int = 0


def site_rule(rule: str, action: str, rank: int = 1) -> UrlRule:
    """A rule ``host/path``: the host with its subdomains, and paths that start alike."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    end = re.escape(path) if path else "(?=/|$)"
    pattern = rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{end}"
    # The last run of a path can go on in the URL, so it is no whole token there.
    whole = re.sub(r"[a-z0-9]+$", "", path.lower()) if path else ""
    tokens = tuple(sorted(set(re.findall(r"[a-z0-9]+", host.lower() + whole))))
    return UrlRule(rule, action, pattern, tokens, rank)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def _tokens(target: Column) -> Column:
    runs = F.array_distinct(F.split(ascii_lower(target), "[^a-z0-9]+"))
    return F.array_union(F.array(F.lit("")), runs)


def rule_index(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """(token, rule, pattern) with each rule under its rarest token over the URLs.

    ``urls`` has one row per distinct URL with its ``target``.
    """
    spark = urls.sparkSession
    pairs = [(i, t) for i, r in enumerate(rules) for t in (r.tokens or ("",))]
    literals = staged(rows_table(spark, pairs, "rule int, token string"))
    wanted = sorted({t for _, t in pairs})
    counts = (
        urls.select(F.explode(_tokens(F.col("target"))).alias("token"))
        .where(F.col("token").isin(wanted))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = literals.join(counts, "token", "left").fillna(0, ["n"])
    rarest = counted.groupBy("rule").agg(F.min(F.struct("n", "token")).alias("rarest"))
    patterns = rows_table(spark, [(i, r.pattern) for i, r in enumerate(rules)], "rule int, pattern string")
    return staged(rarest.join(patterns, "rule").select("rarest.token", "rule", "pattern"))


def match_urls(df: DataFrame, url: str, rules: list[UrlRule]) -> DataFrame:
    """One row per distinct URL: url, best_rule (position in ``rules``) or null."""
    urls = df.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    urls = urls.withColumn("target", F.concat(url_host(F.col("url")), url_path(F.col("url"))))
    if not rules:
        return urls.select("url", F.lit(None).cast("int").alias("best_rule"))
    index = rule_index(urls, rules)
    hits = (
        urls.select("url", "target", F.explode(_tokens(F.col("target"))).alias("token"))
        .join(index, "token")
        .where(F.expr("target RLIKE pattern"))
    )
    # One number orders the rules: rank, then length of the name, then the earlier one.
    order = sorted(range(len(rules)), key=lambda i: (rules[i].rank, len(rules[i].name), -i))
    place = {rule: at for at, rule in enumerate(order)}
    weight = F.array(*[F.lit(place[i]) for i in range(len(rules))])
    rule_at = F.array(*[F.lit(i) for i in order])
    best = hits.groupBy("url").agg(F.max(F.get(weight, F.col("rule"))).alias("place"))
    return best.select("url", F.get(rule_at, F.col("place")).alias("best_rule"))


def judge_urls(df: DataFrame, rules: list[UrlRule], default: str = "allow", url: str = "url") -> DataFrame:
    """The rows of ``df`` with host, path, rule_at (position of the best rule) and verdict."""
    best = match_urls(df, url, rules).select(F.col("url").alias("__url"), F.col("best_rule").alias("rule_at"))
    actions = F.array(*[F.lit(r.action) for r in rules]) if rules else F.array(F.lit(default))
    # A null url meets no rule; the join leaves it as it is.
    own = df.drop("rule_at")
    joined = own.join(best, own[url] == best["__url"], "left").drop("__url")
    return joined.withColumns(
        {
            "host": url_host(F.col(url)),
            "path": url_path(F.col(url)),
            "verdict": F.coalesce(F.get(actions, F.col("rule_at")), F.lit(default)),
        }
    )
