"""Streaming forms: rate limiting with state, re-indexing, windowed telemetry and the answer cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators import cache as K
from corpusmill.operators.chunking import chunk_corpus
from corpusmill.operators.embedding import hash_embed
from corpusmill.operators.index_store import term_counts
from corpusmill.operators.indexing import insert_chunks
from corpusmill.operators.ratelimit import FIELDS, KeyWindow


#: What a session needs for streams with timers.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Windows(StatefulProcessor):
    """A key's open window as state, with a timer that sweeps it when the stream's watermark has passed its end."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("window", "reset long, count int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        window = KeyWindow(*held) if held else KeyWindow()
        mine = pd.concat([r[["t", "id"]] for r in rows]).sort_values(["t", "id"])
        told = [(i, key[0], *window.ask(t, self.limit, self.window_us)) for i, t in zip(mine["id"].tolist(), mine["t"].tolist())]
        if held and held[0] != window.reset:
            self.handle.deleteTimer(held[0] // 1000 + 1)
        if not held or held[0] != window.reset:
            self.handle.registerTimer(window.reset // 1000 + 1)
        self.state.update((window.reset, window.count))
        yield pd.DataFrame(told, columns=["id", "key", "allowed", "remaining", "reset_in_us"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["id", "key", "allowed", "remaining", "reset_in_us"])

    def close(self) -> None:
        pass


def rate_limit(requests: DataFrame, limit: int, window_us: int) -> DataFrame:
    """The decisions of replay() over a stream of id, key and ts, with one open window per key as state.

    Rows of a key are taken in order of time and id inside a batch; rows later than a minute are left out. The session must keep
    its state as ROCKSDB says; memory then doesn't grow with the number of keys, and a key's state goes with its window.
    """
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 minute").withColumn("t", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithStateInPandas(Windows(limit, window_us), FIELDS, "Append", "EventTime")


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    empty = spark.createDataFrame([], schema)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else empty


COUNTED = T.StructType([T.StructField(n, t) for n, t in (("term", T.StringType()), ("df", T.LongType()), ("tf", T.LongType()), ("chunks", T.LongType()), ("words", T.LongType()), ("batch", T.IntegerType()))])


def _changes(chunks: DataFrame, stop_words: list[str]) -> DataFrame:
    """What chunks (repo_id, content_hash, content) add to the statistics: a row for each term, and one without a term for how many chunks and words."""
    counts = term_counts(chunks.select(F.struct("repo_id", "content_hash").alias("chunk_id"), "content"), "content", stop_words)
    each = counts.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.count(F.lit(1)).alias("df"), F.sum("x.tfs").alias("tf"))
    none = F.lit(0).cast("long")
    whole = counts.agg(F.count_if(F.col("dl") > 0).alias("chunks"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
    return each.select("term", "df", "tf", none.alias("chunks"), none.alias("words")).unionByName(whole.select(F.lit(None).cast("string").alias("term"), none.alias("df"), none.alias("tf"), "chunks", "words"))


def reindex(files: DataFrame, path: str, checkpoint: str, dim: int = 1536, stop_words: list[str] = ()) -> StreamingQuery:
    """Chunks of new files with their embeddings, and what they change in the statistics of BM25, each batch in folders of its own.

    Rows are known by repository and hash. A batch looks at earlier ones only, so one that runs twice writes the same again. Statistics
    are sums of changes, so they need no second look at the chunks: statistics() after any batches is that of all chunks at once.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark, new = batch.sparkSession, chunk_corpus(batch)
        known = T.StructType([new.schema["repo_id"], new.schema["content_hash"], T.StructField("batch", T.IntegerType())])
        fresh = insert_chunks(_stored(spark, f"{path}/chunks", known).where(F.col("batch") < n), new, ["path", "start_line"])
        made = hash_embed(fresh.select(F.struct(*new.columns).alias("row"), "content"), "row", "content", dim).select("row.*", "embedding")
        made.write.mode("overwrite").parquet(f"{path}/chunks/batch={n}")
        now = spark.read.schema(made.schema).parquet(f"{path}/chunks/batch={n}")
        _changes(now, list(stop_words)).write.mode("overwrite").parquet(f"{path}/changes/batch={n}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retire(spark: SparkSession, path: str, repos: DataFrame, batch: int, stop_words: list[str] = ()) -> None:
    """Takes the chunks of some repositories (column repo_id) out of the statistics: the same changes with the other sign, as batch `batch`, below 0."""
    gone = _changes(spark.read.parquet(f"{path}/chunks").join(repos.select("repo_id").distinct(), "repo_id", "left_semi"), list(stop_words))
    gone.select("term", *((-F.col(c)).alias(c) for c in ("df", "tf", "chunks", "words"))).write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")


def statistics(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """term, df and tf of every term that chunks have; and one row of chunks with words and words."""
    rows = _stored(spark, f"{path}/changes", COUNTED)
    terms = rows.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") > 0)
    return terms, rows.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))


def windowed_totals(log: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Telemetry totals per tumbling window of created_at; rows later than `late` are left out."""
    timed = log.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    hits = F.count_if("cache_hit")
    return timed.groupBy(F.window("created_at", window)).agg(F.count(F.lit(1)).alias("queries"), hits.alias("cache_hits"), (hits / F.count(F.lit(1))).alias("hit_rate"), F.sum("cost_usd").alias("cost_usd"), F.count_if("injection").alias("injections"))


def keep_latest(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream of totals that change as rows come in; every batch's changes are a folder of their own, so one that runs twice replaces itself."""

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return totals.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What keep_latest() wrote: of every key the row of the last batch, open windows included."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*keys, "last.*")


CACHED = ["id", "repo_id", "embed_model", "question", "embedding"]


def cached(spark: SparkSession, cache_path: str, out_path: str, asked: T.StructType, before: int | None = None) -> DataFrame:
    """The cache as it is before a batch (or now), with the hits that were counted so far."""
    kinds = {f.name: f.dataType for f in asked.fields} | {"id": asked["question_id"].dataType}
    store = T.StructType([*(T.StructField(c, kinds[c]) for c in CACHED), T.StructField("batch", T.IntegerType())])
    found = T.StructType([T.StructField("cached_id", kinds["id"]), T.StructField("hit", T.BooleanType()), T.StructField("batch", T.IntegerType())])
    earlier = F.lit(True) if before is None else F.col("batch") < before
    rows, hits = (_stored(spark, at, schema).where(earlier).drop("batch") for at, schema in ((cache_path, store), (out_path, found)))
    return K.count_hits(rows.withColumn("hits", F.lit(0)), hits)


def answer_cache(questions: DataFrame, cache_path: str, out_path: str, checkpoint: str, threshold: float = K.THRESHOLD) -> StreamingQuery:
    """Questions (with their answers) against the cache: found ones are written with their answer's id, others are stored if they may be.

    A question doesn't meet those of its own batch. Both tables get a folder per batch, so one that runs twice replaces
    what it wrote; hits are counted from the found ones.
    """

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        found = K.lookup(batch, cached(spark, cache_path, out_path, batch.schema, n), threshold).select("question_id", "cached_id", "similarity", "hit")
        found.write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        missed = spark.read.schema(found.schema).parquet(f"{out_path}/batch={n}").where("NOT hit")
        new = K.admitted(batch.join(missed, "question_id", "left_semi")).select(F.col("question_id").alias("id"), *CACHED[1:])
        new.write.mode("overwrite").parquet(f"{cache_path}/batch={n}")

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
