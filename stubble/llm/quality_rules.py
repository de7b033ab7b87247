"""Quality rules with risk-controlled cutoffs.

Each rule rejects documents whose measure (a whole number per mille) lies above a cutoff.
Cutoffs are chosen on labelled documents per stratum: a cutoff is certified when the exact
binomial test rejects "the rule drops more than its share of good documents", that is
when ``P(Bin(n, risk) <= k) <= delta / tests`` with k of n good documents above the cutoff.
Stricter cutoffs drop more, so the p-values rise along the grid and the strictest
certified cutoff is found by testing from lenient to strict (a fixed sequence needs no
further correction). Rules and strata are corrected by Bonferroni, and the rules of a
stratum share its risk, so that together they drop at most ``risk`` of its good documents
with probability ``1 - delta``. A pair of rule and stratum without a certified cutoff
rejects nothing.

Everything is DataFrame functions. Measures are computed per row; the labelled counts are
partial sums per (stratum, rule, cutoff).

Defined cases: null and empty texts have no words and fail the base rule; a null stratum
is the stratum ``""``; labels that contradict each other for one document count as bad;
repeated documents are judged alike; empty labels certify nothing; extra columns stay,
but for those with the name of a measure, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stubble.llm.common import SPACES, let
from stubble.operators.staging import staged

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
_BLANKS = r"[\x20\x09-\x0D]"
#: Cutoffs per mille, from lenient to strict.
CUTOFFS = (900, 700, 500, 400, 300, 250, 200, 150, 100, 75, 50, 30, 20, 10)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more; ``hashes`` has one per window."""

    def covered(windows):
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s):
            def twice(x, j):
                before = F.get(s, j - 1)["h"] == x["h"]
                after = F.get(s, j + 1)["h"] == x["h"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["i"]))

        def spanned(at):
            steps = F.transform(
                at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))
            )
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(ordered, marked), spanned)

    return let(
        hashes,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(
            covered(w)
        ),
    )


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts and ``n_lines``, ``n_upper`` to every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, SPACES), lambda w: w != F.lit(""))
    word_hashes = F.transform(words, lambda w: F.xxhash64(w))

    def window_hashes(wh):
        starts = F.sequence(F.lit(0), F.size(wh) - WINDOW)
        hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(WINDOW)]))
        return F.when(F.size(wh) >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>"))

    word_counts = let(
        word_hashes,
        lambda wh: F.struct(
            F.size(wh).cast("long").alias("n"), _repeat_words(window_hashes(wh)).alias("r")
        ),
    )
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(
        lines,
        lambda a: F.struct(
            F.size(a).cast("long").alias("n"),
            (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("d"),
        ),
    )

    def found(pattern):
        return F.regexp_count(body, F.lit(pattern)).cast("long")

    out = df.withColumns({"__words": word_counts, "__lines": line_counts})
    return out.withColumns(
        {
            "n_words": F.col("__words.n"),
            "word_chars": F.length(body) - found(_BLANKS),
            "n_symbols": found(SYMBOLS),
            "n_dup_lines": F.col("__lines.d"),
            "n_repeat_words": F.col("__words.r"),
            "n_lines": F.col("__lines.n"),
            "n_upper": found("[A-Z]"),
        }
    ).drop("__words", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _per_mille(part: str, whole: str) -> Column:
    return F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("int")


def measures() -> dict[str, Column]:
    """Rule name to measure per mille; higher is worse."""
    return {
        "symbols": _per_mille("n_symbols", "word_chars"),
        "upper": _per_mille("n_upper", "word_chars"),
        "dup_lines": _per_mille("n_dup_lines", "n_lines"),
        "repeats": _per_mille("n_repeat_words", "n_words"),
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from its largest term so that long sums stay exact."""
    # Terms from k downward: t(i-1) = t(i) * i (1-p) / ((n-i+1) p). They fall once i is
    # below n p; the sum is scaled by t(k), whose logarithm comes from a sum of logs.
    odds = (1.0 - p) / p

    def log_choose(n_, k_):
        low = F.when(k_ < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), k_.cast("int")))
        return F.aggregate(
            low, F.lit(0.0), lambda a, i: a + F.log((n_ - k_ + i).cast("double") / i.cast("double"))
        )

    log_top = log_choose(n, k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p))
    down = F.when(k < 1, F.array().cast("array<int>")).otherwise(
        F.sequence(k.cast("int"), F.lit(1), F.lit(-1))
    )

    def step(acc, i):
        term = acc["t"] * i.cast("double") * F.lit(odds) / (n - i + 1).cast("double")
        return F.struct((acc["s"] + term).alias("s"), term.alias("t"))

    total = F.aggregate(down, F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t")), step)["s"]
    # Above the mean the test can never certify; there the terms would grow without bound.
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.exp(log_top + F.log(total)))


def certified_cutoffs(
    features: DataFrame, labels: DataFrame, stratum: str, risk: float = 0.02, delta: float = 0.05
) -> DataFrame:
    """(stratum, one column per rule): the strictest certified cutoff, null where none is.

    ``features`` holds doc_id, the stratum and the output of ``measured``; ``labels``
    doc_id and quality. The result has one row per stratum of the labelled documents.
    """
    rules = list(measures())
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    part = F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")
    rows = features.where(~base_failed()).select("doc_id", part, *[m.alias(r) for r, m in measures().items()])
    held = rows.join(good.select("doc_id"), "doc_id")
    counts = staged(
        held.groupBy("stratum").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(F.col(r) > c).alias(f"{r}_{c}") for r in rules for c in CUTOFFS],
        )
    )
    level = delta / (max(1, counts.count()) * len(rules))
    cells = F.inline(
        F.array(
            *[
                F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}").alias("k"))
                for r in rules
                for c in CUTOFFS
            ]
        )
    )
    tests = counts.select("stratum", "n", cells)
    sure = tests.where(binomial_tail(F.col("n"), F.col("k"), risk / len(rules)) <= F.lit(level))
    chosen = sure.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in rules]
    )
    return staged(chosen)


def with_verdict(features: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Adds base_failed and kept; a rule without a cutoff rejects nothing."""
    part = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    joined = features.withColumn("stratum", part).join(cutoffs, "stratum", "left")
    bad = base_failed()
    for rule, measure in measures().items():
        bad = bad | F.coalesce(measure > F.col(f"cut_{rule}"), F.lit(False))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~bad}).drop(
        "stratum", *[f"cut_{r}" for r in measures()]
    )
