"""Streaming queries, run to the end of what the tables hold, and the report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import evaluation as V
from corpusmill.plans.bindings import table, work_dir
from corpusmill.plans.corpus_queries import TO_CHUNKS
from corpusmill.plans.index_queries import AVERAGES, DAY, RATE, TO_MEASURES, measures, rounded
from corpusmill.plans.search_queries import DIM, LETTERS_ONLY, STEM, STOP
from corpusmill.streaming import jobs

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files: the folder's files where the table is one, else the one file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream to the end of its input into Parquet and reads that."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("w2_rate_limit_stream", RATE)
def w2(spark, d):
    at = work_dir(spark, "rate-limit")
    requests = stream_of(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts")
    key, held = jobs.ROCKSDB[0], spark.conf.get(jobs.ROCKSDB[0], None)
    spark.conf.set(*jobs.ROCKSDB)
    try:
        return drained(jobs.rate_limit(requests, 3, DAY), f"{at}/out", f"{at}/state")
    finally:
        spark.conf.set(key, held) if held else spark.conf.unset(key)


FROM_DOCS = TO_CHUNKS.replace("UNION ALL SELECT repo_id, path, content FROM text_files", "WHERE false UNION ALL SELECT source, lang || '/' || doc_id || '.md', text FROM documents")


def reindexed(spark, d):
    """The folder of a re-index stream over the documents, run to its end."""
    at = work_dir(spark, "reindex")
    files = stream_of(spark, d, "documents").select(F.col("source").alias("repo_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"))
    jobs.reindex(files, at, f"{at}/state", DIM, STOP).awaitTermination()
    return at


@query("w3_streaming_reindex", f"{FROM_DOCS} SELECT DISTINCT repo_id, path, start_line, end_line, content_hash FROM chunks")
def w3(spark, d):
    rows = spark.read.parquet(f"{reindexed(spark, d)}/chunks").where(F.size("embedding") == DIM)
    return rows.select("repo_id", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content_hash")


WORDS_IN = f"""once AS (SELECT repo_id, content_hash, min(content) AS content FROM chunks GROUP BY repo_id, content_hash), said AS (SELECT repo_id, content_hash, unnest(regexp_extract_all(lower(content), '[a-z0-9_]+')) AS raw FROM once)"""


@query("w6_streaming_statistics", f"{FROM_DOCS}, {WORDS_IN} SELECT {STEM.format('raw')} AS term, count(DISTINCT (repo_id, content_hash)) AS df, count(*) AS tf FROM said WHERE raw NOT IN {LETTERS_ONLY} GROUP BY 1")
def w6(spark, d):
    """Document frequencies kept up by the stream."""
    return jobs.statistics(spark, reindexed(spark, d))[0]


@query("w4_streaming_obs", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS queries, count_if(event_type = 'view') AS cache_hits, round(count_if(event_type = 'view') / count(*)::DOUBLE, 6) AS hit_rate,
  round(sum(CASE WHEN event_type = 'purchase' THEN value / 1000 ELSE 0.0 END), 6) AS cost_usd, count_if(event_type = 'error') AS injections FROM events GROUP BY 1""")
def w4(spark, d):
    at = work_dir(spark, "totals")
    e = stream_of(spark, d, "events")
    log = e.select(F.col("ts").alias("created_at"), (F.col("event_type") == "view").alias("cache_hit"), F.when(F.col("event_type") == "purchase", F.col("value") / 1000).otherwise(0.0).alias("cost_usd"), (F.col("event_type") == "error").alias("injection"))
    jobs.keep_latest(jobs.windowed_totals(log), f"{at}/out", f"{at}/state").awaitTermination()
    out = jobs.latest(spark, f"{at}/out", ["window"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "queries", "cache_hits", F.round("hit_rate", 6).alias("hit_rate"), F.round("cost_usd", 6).alias("cost_usd"), "injections")


ASKED_IN = 4  # batches


def _cache_sql() -> str:
    """The batches one after the other: a question is found if an earlier batch stored one alike, and is stored if not found and its answer may be kept."""
    each = ["asked AS (SELECT vec_id AS question_id, label AS repo_id, embedding, vec_id % 4 AS batch, vec_id % 7 <> 0 AND vec_id % 11 <> 0 AS fit FROM embeddings)", "stored0 AS (SELECT * FROM asked WHERE false)"]
    for b in range(ASKED_IN):
        near = f"SELECT a.question_id, c.question_id AS cached_id, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity FROM asked a JOIN stored{b} c ON a.repo_id = c.repo_id WHERE a.batch = {b}"
        each.append(f"found{b} AS (SELECT question_id, cached_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, cached_id) AS n FROM ({near})) WHERE n = 1 AND similarity >= 0.3)")
        each.append(f"stored{b + 1} AS (SELECT * FROM stored{b} UNION ALL SELECT * FROM asked WHERE batch = {b} AND fit AND question_id NOT IN (SELECT question_id FROM found{b}))")
    found = " UNION ALL ".join(f"SELECT * FROM found{b}" for b in range(ASKED_IN))
    return f"WITH {', '.join(each)}, found AS ({found}), hits AS (SELECT cached_id, count(*) AS n FROM found GROUP BY cached_id) SELECT a.question_id, f.cached_id, round(f.similarity, 6) AS similarity, f.cached_id IS NOT NULL AS hit, s.question_id IS NOT NULL AS stored, coalesce(h.n, 0) AS hits FROM asked a LEFT JOIN found f ON f.question_id = a.question_id LEFT JOIN stored{ASKED_IN} s ON s.question_id = a.question_id LEFT JOIN hits h ON h.cached_id = a.question_id"


@query("w5_streaming_cache", _cache_sql())
def w5(spark, d):
    at = work_dir(spark, "cache")
    v = F.col("vec_id")
    asked = table(spark, d, "embeddings").select(v.alias("question_id"), F.col("label").alias("repo_id"), F.lit("m").alias("embed_model"), F.concat(F.lit("q"), v.cast("string")).alias("question"), "embedding", F.lit("an answer").alias("answer"), (v % 7 == 0).alias("has_history"), (v % 11 == 0).alias("degraded"))
    for b in range(ASKED_IN):  # files that arrive one after the other
        asked.where(F.col("question_id") % ASKED_IN == b).coalesce(1).write.mode("append").parquet(f"{at}/asked")
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/asked")
    jobs.answer_cache(stream, f"{at}/cache", f"{at}/out", f"{at}/state", 0.3).awaitTermination()
    cache = jobs.cached(spark, f"{at}/cache", f"{at}/out", asked.schema).select(F.col("id").alias("question_id"), "hits", F.lit(True).alias("stored"))
    out = spark.read.parquet(f"{at}/out").select("question_id", "cached_id", F.round("similarity", 6).alias("similarity"), "hit").join(cache, "question_id", "left")
    return out.select("question_id", "cached_id", "similarity", "hit", F.coalesce("stored", F.lit(False)).alias("stored"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


@query("s13_write_eval_report", f"{TO_MEASURES} SELECT config, {AVERAGES} FROM averages")
def s13(spark, d):
    at = work_dir(spark, "report")
    rounded(V.macro_average(measures(spark, d))).coalesce(1).write.json(at)  # a few rows
    return spark.read.schema("config string, " + ", ".join(f"{c} double" for c in ("recall_5", "recall_10", "hit_5", "precision_5", "ndcg_10", "mrr"))).json(at)
