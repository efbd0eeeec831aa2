"""Keeping an index of chunks up to date: what is new, what stays, what goes; repositories and their status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_chunks(stored: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows to append: those whose (repo_id, content_hash) is not stored, of equal ones the first by `order`."""
    nth = F.row_number().over(Window.partitionBy("repo_id", "content_hash").orderBy(*order))
    return rows.withColumn("__n", nth).where(F.col("__n") == 1).drop("__n").join(stored.select("repo_id", "content_hash"), ["repo_id", "content_hash"], "left_anti")


def upsert_repos(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The whole table after inserting or updating: a new value that is not null wins."""
    s, n = stored.alias("s"), new.alias("n")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c) if c in new.columns else F.col(f"s.{c}") for c in stored.columns]
    return s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def reindex_diff(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """repo_id, content_hash and action: new, reused or pruned. Nothing is pruned in a repository that sent nothing."""
    key = ["repo_id", "content_hash"]
    s, n = stored.select(*key).distinct().withColumn("old", F.lit(True)), incoming.select(*key).distinct().withColumn("now", F.lit(True))
    action = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "pruned").otherwise("reused")
    sent = incoming.select("repo_id").distinct().withColumn("sent", F.lit(True))
    return s.join(n, key, "full_outer").withColumn("action", action).join(sent, "repo_id", "left").where((F.col("action") != "pruned") | F.col("sent")).select(*key, "action")


def with_model_change(diff: DataFrame, repos: DataFrame, model: str) -> DataFrame:
    """The diff where a repository stored under another model keeps nothing: its reused chunks are replaced."""
    changed = repos.where(F.col("embed_model").isNotNull() & (F.col("embed_model") != model)).select(F.col("id").alias("repo_id"), F.lit(True).alias("changed"))
    return diff.join(changed, "repo_id", "left").withColumn("action", F.when((F.col("action") == "reused") & F.col("changed"), "replaced").otherwise(F.col("action"))).drop("changed")


def budgeted_pass(incoming: DataFrame, diff: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """The new chunks that a pass with that budget embeds, by path and line, and each repository's status after it.

    While chunks remain a repository is `indexing` and nothing of it is pruned; the next pass finds the rest by hash.
    """
    new = incoming.join(diff.where(F.col("action").isin("new", "replaced")), ["repo_id", "content_hash"], "left_semi")
    # Only the first `budget` rows of a repository move for the numbering, and counts for the rest, however large it is.
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy("path", "start_line", "content_hash"))
    taken = new.withColumn("nth", nth).where(F.col("nth") <= budget).drop("nth")
    left = F.greatest(F.count(F.lit(1)) - budget, F.lit(0))
    status = incoming.select("repo_id").distinct().join(new.groupBy("repo_id").agg(left.alias("remaining")), "repo_id", "left").select("repo_id", F.coalesce("remaining", F.lit(0)).alias("remaining"))
    return taken, status.withColumn("status", F.when(F.col("remaining") > 0, "indexing").otherwise("ready"))


def delete_repos(table: DataFrame, gone: DataFrame, key: str = "repo_id") -> DataFrame:
    """A table's rows without those of the repositories in gone (column repo_id)."""
    return table.join(gone.select(F.col("repo_id").alias(key)), key, "left_anti")


def repo_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo_id").agg(F.countDistinct("path").alias("file_count"), F.count(F.lit(1)).alias("chunk_count"))
