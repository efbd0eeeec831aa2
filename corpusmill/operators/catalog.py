"""Catalog queries over chunks and repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def read_files(chunks: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Files put together from overlapping chunks: repo_id, path, lang and content of lines low to high; a later chunk's line wins."""
    lines = chunks.select("repo_id", "path", "lang", "start_line", F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("ln", F.col("start_line") + F.col("pos"))
    if low is not None:
        lines = lines.where(F.col("ln") >= low)
    if high is not None:
        lines = lines.where(F.col("ln") <= high)
    one = lines.groupBy("repo_id", "path", "ln").agg(F.max_by("line", "start_line").alias("line"), F.min_by("lang", "start_line").alias("lang"))
    return one.groupBy("repo_id", "path").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("content"))


def list_symbols(chunks: DataFrame, name: str | None = None, limit: int = 50) -> DataFrame:
    """Per repository the first symbols in order, with those that hold `name` only, in any case."""
    found = chunks.where(F.col("symbol").isNotNull())
    if name:
        found = found.where(F.lower("symbol").contains(name.lower()))
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy("symbol", "path", "start_line"))
    return found.withColumn("nth", nth).where(F.col("nth") <= limit)


def language_distribution(chunks: DataFrame) -> DataFrame:
    each = chunks.groupBy("repo_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("share", F.col("n") / F.max("n").over(Window.partitionBy("repo_id")))


def top_files(chunks: DataFrame, k: int = 10) -> DataFrame:
    each = chunks.groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("n"), "path"))
    return each.withColumn("nth", nth).where(F.col("nth") <= k)


def list_repos(repos: DataFrame) -> DataFrame:
    """Repositories by last indexing, never indexed ones last."""
    return repos.orderBy(F.desc_nulls_last("indexed_at"), F.desc("created_at"), "id")


def stale_indexes(repos: DataFrame, model: str) -> DataFrame:
    return repos.where(F.col("embed_model").isNotNull() & (F.col("embed_model") != model))
