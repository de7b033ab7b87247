"""The corpus pipeline: quality rules, quality model, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of ``docs``. ``docs`` should be a written table, because a stage reads it more than
once; ``run`` writes each stage's rows to the shared folder before the next one.

Defined cases, beyond those of the operators: extra columns stay until packing, also those
that bear the name of a measure; repeated rows are copies, one of which stays; rows
without an id are kept by the near-duplicate stage; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stubble.llm import ngram_join, packing, quality_model, quality_rules
from stubble.operators.staging import staged

TOKENIZER = "byte_bpe_50k.json"


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the certified cutoffs keep.

    Cutoffs come from the counts alone; the verdict is then a condition on each row, so
    that no text is shuffled.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counts = staged(quality_rules.measured(docs.select("doc_id", "text", "lang")).drop("text"))
    cutoffs = quality_rules.certified_cutoffs(counts, labels, "lang")
    rows = docs.select(F.struct("*").alias("row"), "text", "lang")
    judged = quality_rules.with_verdict(quality_rules.measured(rows), cutoffs, "lang")
    return judged.where("kept").select("row.*")


def keep_by_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is one half or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    features = staged(quality_model.measured(docs.select("doc_id", "text")))
    model = quality_model.learnt(features, labels)
    scored = quality_model.scored_texts(docs, model, name="__quality_score")
    return scored.where(F.col("__quality_score") >= 0.5).drop("__quality_score")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each similarity component."""
    found = staged(ngram_join.similarity_components(docs))
    gone = found.where("doc_id <> component_id").select("doc_id")
    again = (
        found.where("doc_id = component_id")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("doc_id")
    )
    again = staged(again)
    out = staged(gone.union(again).distinct())
    once = docs.join(out, "doc_id", "left_anti")
    first = docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(first).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_model", keep_by_model),
    ("ngram_join", keep_one_of_each),
    ("packing", pack),
]
#: The trained model and the retrieval of neighbours have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
