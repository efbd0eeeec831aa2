"""The semantic answer cache: lookup by nearest question, counting hits, admission."""

from __future__ import annotations

from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import columns as C
from corpusmill.operators.retrieval import nearest

THRESHOLD = 0.92


def lookup(questions: DataFrame, cache: DataFrame, threshold: float = THRESHOLD, met: Accumulator | None = None) -> DataFrame:
    """questions with cached_id, similarity and hit: the nearest cached question of the same repository and model.

    Questions meet the cache in counted blocks, pairs that can't reach the threshold aren't compared (`met` counts those that are),
    and every task keeps the best of each question before anything moves, however many rows a repository has.
    """
    near = nearest(questions, cache.withColumnRenamed("id", "cached_id"), 1, ["repo_id", "embed_model"], query_id="question_id", chunk_id="cached_id", places=9, least=threshold, met=met)
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("similarity"), "cached_id"))
    best = near.withColumn("n", nth).where(F.col("n") == 1).drop("n")
    return questions.join(best, "question_id", "left").withColumn("hit", F.col("cached_id").isNotNull())


def count_hits(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache with hits added to every row of a repository and question that was hit, repeated rows included."""
    hit = found.where("hit").select(F.col("cached_id").alias("id")).join(cache.select("id", "repo_id", "question"), "id")
    n = hit.groupBy("repo_id", "question").agg(F.count(F.lit(1)).alias("more"))
    return cache.join(n, ["repo_id", "question"], "left").withColumn("hits", F.col("hits") + F.coalesce("more", F.lit(0))).drop("more")


def admitted(answers: DataFrame) -> DataFrame:
    """Answers to store: not empty, without history, not degraded."""
    return answers.where((F.length(C.trimmed(F.coalesce("answer", F.lit("")))) > 0) & ~F.col("has_history") & ~F.col("degraded"))
