"""Measures of ranked retrieval, for runs of many cases and configurations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GATE = {"recall_5": 0.75, "mrr": 0.60, "ndcg_10": 0.65}


def dedupe_by_path(run: DataFrame) -> DataFrame:
    """config, case_id, path and rank: the first rank of each path, ranked anew without gaps."""
    first = run.groupBy("config", "case_id", "path").agg(F.min("rank").alias("r"))
    return first.select("config", "case_id", "path", F.row_number().over(Window.partitionBy("config", "case_id").orderBy("r")).alias("rank"))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run with rel (0 or 1)."""
    return run.join(qrels.select("case_id", "path", F.lit(1).alias("rel")).distinct(), ["case_id", "path"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def case_measures(run: DataFrame, qrels: DataFrame, cases: DataFrame) -> DataFrame:
    """All measures of each config and case; a case without results has zeros.

    recall_5, recall_10, hit_5, precision_5 (of what was returned), rr, ndcg_10 and top_path.
    """
    rows = judged(run, qrels)
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
    found = rows.groupBy("config", "case_id").agg(
        at(5).alias("f5"), at(10).alias("f10"), F.count_if(F.col("rank") <= 5).alias("n5"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("best"),
        F.sum(F.when((F.col("rel") == 1) & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min_by("path", "rank").alias("top_path"),
    )
    total = qrels.select("case_id", "path").distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("total"))
    grid = run.select("config").distinct().crossJoin(cases.select("case_id").distinct())  # configurations are a few names
    full = grid.join(total, "case_id", "left").join(found, ["config", "case_id"], "left").fillna(0, ["total", "f5", "f10", "n5", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("total"), F.lit(10)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    recall = lambda c: F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col(c) / F.col("total"))).otherwise(0.0)
    return full.select(
        "config", "case_id", recall("f5").alias("recall_5"), recall("f10").alias("recall_10"), F.when(F.col("f5") > 0, 1.0).otherwise(0.0).alias("hit_5"), F.when(F.col("n5") > 0, F.col("f5") / F.col("n5")).otherwise(0.0).alias("precision_5"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"), F.when(F.col("total") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg_10"), "top_path",
    )


def macro_average(measures: DataFrame) -> DataFrame:
    cols = ["recall_5", "recall_10", "hit_5", "precision_5", "ndcg_10"]
    return measures.groupBy("config").agg(*[F.avg(c).alias(c) for c in cols], F.avg("rr").alias("mrr"))


def ablation(averages: DataFrame) -> DataFrame:
    """One row: the configuration with the best MRR, and whether the hybrid is at least as good as each arm."""
    best = averages.agg(F.max_by("config", F.struct("mrr", "config")).alias("best"), F.max(F.when(F.col("config") == "hybrid", F.col("mrr"))).alias("h"), F.max(F.when(F.col("config") != "hybrid", F.col("mrr"))).alias("arms"))
    return best.select("best", (F.col("h") >= F.col("arms")).alias("hybrid_holds"))


def quality_gate(averages: DataFrame, floors: dict[str, float] | None = None) -> DataFrame:
    """config, passed and the measures below their floor."""
    floors = floors or GATE
    below = F.filter(F.array(*[F.when(F.col(m) < f, F.lit(m)) for m, f in floors.items()]), lambda x: x.isNotNull())
    return averages.select("config", (F.size(below) == 0).alias("passed"), F.array_join(below, ",").alias("failures"))


def misses(measures: DataFrame) -> DataFrame:
    return measures.where(F.col("hit_5") == 0).select("config", "case_id", "top_path")
