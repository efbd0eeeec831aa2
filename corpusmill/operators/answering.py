"""Answering a table of questions: screen, ask the cache, tell the rest from their hits, keep and log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import columns as C
from corpusmill.operators import cache as K


def answer_batch(questions: DataFrame, cache: DataFrame, told: DataFrame, threshold: float = K.THRESHOLD) -> DataFrame:
    """question_id, repo_id, embed_model, question, injection, mode, cache_hit, cached_id, n_retrieved, answer and stored.

    questions has question_id, repo_id, embed_model, question, embedding, has_history and degraded; cache the stored
    questions with their answer; told what retrieval answers (question_id, answer, n_retrieved). A question with a
    history doesn't ask the cache. Flagged ones are answered too, but marked. What may be kept is marked as stored.
    """
    found = K.lookup(questions.where(~F.col("has_history")), cache, threshold).where("hit").select("question_id", "cached_id")
    kept = cache.select(F.col("id").alias("cached_id"), F.col("answer").alias("cached_answer"))
    hit = F.col("cached_id").isNotNull()
    rows = questions.join(found, "question_id", "left").join(kept, "cached_id", "left").join(told, "question_id", "left")
    out = rows.select(
        "question_id", "repo_id", "embed_model", "question", C.injection_reason(F.col("question")).isNotNull().alias("injection"), F.when(hit, "cache").otherwise("local").alias("mode"), hit.alias("cache_hit"), "cached_id",
        F.when(hit, F.lit(0)).otherwise(F.coalesce("n_retrieved", F.lit(0))).cast("long").alias("n_retrieved"), F.when(hit, F.col("cached_answer")).otherwise(F.col("answer")).alias("answer"), "has_history", "degraded",
    )
    may = (F.length(C.trimmed(F.coalesce("answer", F.lit("")))) > 0) & ~F.col("has_history") & ~F.col("degraded")
    return out.withColumn("stored", may & ~F.col("cache_hit")).drop("has_history", "degraded")


def to_store(answers: DataFrame) -> DataFrame:
    """Rows of answer_batch() that go into the cache."""
    return answers.where("stored").select(F.col("question_id").alias("id"), "repo_id", "embed_model", "question", "answer")


def to_log(answers: DataFrame) -> DataFrame:
    """Rows of answer_batch() as the query log has them."""
    return answers.select("question_id", "repo_id", F.substring("question", 1, 500).alias("question"), "mode", "cache_hit", "n_retrieved", "injection")
