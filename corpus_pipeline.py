"""A pipeline from raw documents to packed training sequences.

Toxic documents go, then exact copies, then all but one document of each group of near copies, then sentences of
repeated passages; what is left is packed. Every stage works on all rows that the one before kept. A stage's result is
written before the next one begins, which first deletes the tables that earlier stages over the same folder needed on
their way.

Defined cases: null and empty texts stay through toxicity (unless the curve rejects texts without words), are equal to
each other in exact_dedup, are linked with nothing in ngram_join, unchanged in substring_dedup, and one piece that holds
the end mark in packing; null ids count after all others; repeated rows are copies; further columns pass through all
stages but packing, whatever their names; without labels nothing is toxic; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import op1_substring_dedup, op6_toxicity, op7_packing, op9_ngram_join, op10_exact_dedup
from corpusmill.llm.folds import fold
from corpusmill.llm.op4_bpe import tokenizer_path
from corpusmill.llm.spaces import documents, drop, materialize, scratch, sweep


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, those with a null or empty text included."""
    sweep(spark, sf_dir)
    with scratch(sf_dir):
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 3) != 1)
        scored = op6_toxicity.score(docs, op6_toxicity.fit(docs, labels))
        return scored.where(F.col(scored.columns[-1]) < op6_toxicity.THRESHOLD).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    sweep(spark, sf_dir)
    with scratch(sf_dir):
        return op10_exact_dedup.keep_first(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id."""
    sweep(spark, sf_dir)
    with scratch(sf_dir):
        return op9_ngram_join.keep_one(docs, percent=80, shingle=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the sentences that a repeated passage covers; n_chars is counted anew."""
    sweep(spark, sf_dir)
    with scratch(sf_dir):
        return op1_substring_dedup.substring_dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the sequences."""
    sweep(spark, sf_dir)
    with scratch(sf_dir):
        return op7_packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("substring_dedup", substring_dedup), ("packing", packing)]

#: Toxicity needs a fitted language model and packing a tokenizer; SQL expresses neither, so tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}", keep=True)
            if k:
                drop(before)
    return docs
