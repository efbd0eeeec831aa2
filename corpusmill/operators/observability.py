"""Aggregates of the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(log: DataFrame) -> DataFrame:
    """One row: queries, cache hits, hit rate, mean latency, cost, injections; zeros for an empty log."""
    hits = F.count_if("cache_hit")
    n = F.count(F.lit(1))
    return log.agg(n.alias("queries"), hits.alias("cache_hits"), F.when(n > 0, hits / n).otherwise(0.0).alias("hit_rate"), F.coalesce(F.round(F.avg("latency_ms")), F.lit(0.0)).alias("avg_latency_ms"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.count_if("injection").alias("injections"))


def latency_p95(log: DataFrame, exact: bool = True) -> DataFrame:
    """One row; exact needs all latencies' counts, else a sketch of fixed size is used."""
    p = F.percentile("latency_ms", 0.95) if exact else F.percentile_approx("latency_ms", 0.95, 10_000).cast("double")
    return log.agg(F.coalesce(p, F.lit(0.0)).alias("p95_latency_ms"))


def cost_saved(log: DataFrame) -> DataFrame:
    """Mean cost of paid queries times the number of cache hits."""
    paid = F.avg(F.when(~F.col("cache_hit") & (F.col("cost_usd") > 0), F.col("cost_usd")))
    return log.agg(F.coalesce(paid * F.count_if("cache_hit"), F.lit(0.0)).alias("cost_saved_usd"))


def recent(log: DataFrame, k: int = 12) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def append_rows(log: DataFrame) -> DataFrame:
    """Log rows as they are stored: questions cut to 500 characters."""
    return log.withColumn("question", F.substring("question", 1, 500))


SKETCH_K, SKETCH_LG = 400, 12  # a KLL sketch's rank is off by about 0.01 at most, an HLL sketch's count by about 2 % (one deviation)


def sketches(log: DataFrame, unit: str = "day") -> DataFrame:
    """Per unit of created_at its queries, a KLL sketch of latencies and an HLL sketch of who asked (user_id): small rows that can be merged over any time."""
    return log.groupBy(F.date_trunc(unit, "created_at").alias("start")).agg(F.count(F.lit(1)).alias("queries"), F.kll_sketch_agg_bigint("latency_ms", SKETCH_K).alias("latencies"), F.hll_sketch_agg("user_id", SKETCH_LG).alias("users"))


def merged(daily: DataFrame, unit: str = "week", p: float = 0.95) -> DataFrame:
    """Sketches merged over longer units: start, queries, latency (the quantile p) and users; the log isn't read again."""
    both = daily.groupBy(F.date_trunc(unit, "start").alias("start")).agg(F.sum("queries").alias("queries"), F.kll_merge_agg_bigint("latencies", SKETCH_K).alias("latencies"), F.hll_union_agg("users").alias("users"))
    return both.select("start", "queries", F.kll_sketch_get_quantile_bigint("latencies", F.lit(p)).alias("latency"), F.hll_sketch_estimate("users").alias("users"))
