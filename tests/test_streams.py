"""Re-indexing streams: vectors, statistics that are kept up, batches that run twice."""

from __future__ import annotations

import random
import shutil

from pyspark.sql import functions as F

from corpusmill.operators import embedding
from corpusmill.streaming import jobs

SCHEMA = "repo_id string, path string, content string"


def files(n=60):
    rng = random.Random(2)
    return [(f"r{i % 3}", f"d/{i}.md", "\n".join(f"## part {rng.randint(0, 9)}\n" + " ".join(rng.choice(["storms", "boat", "the", "gulls", "x_y"]) for _ in range(12)) for _ in range(3))) for i in range(n)] + [("r0", "d/0b.md", ""), ("r1", "d/1.md", None)]


def run(spark, at, rows, batches):
    for b in range(batches):
        spark.createDataFrame(rows[b::batches], SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    jobs.reindex(stream, f"{at}/out", f"{at}/state", 32, ["the"]).awaitTermination()


def told(spark, at):
    terms, whole = jobs.statistics(spark, f"{at}/out")
    return {(r.term, r.df, r.tf) for r in terms.collect()}, tuple(whole.first())


def test_statistics_after_any_batches(spark, tmp_path):
    ends = []
    for batches in (1, 4):
        at = str(tmp_path / str(batches))
        run(spark, at, files(), batches)
        chunks = spark.read.parquet(f"{at}/out/chunks")
        assert chunks.count() == chunks.select("repo_id", "content_hash").distinct().count()
        ends.append((told(spark, at), {(r.repo_id, r.content_hash) for r in chunks.collect()}))
    assert ends[0] == ends[1] and ends[0][0][1][0] == len(ends[0][1])
    assert not {"the"} & {t for t, *_ in ends[0][0][0]} and {"storm", "gull"} <= {t for t, *_ in ends[0][0][0]}
    # Vectors are those of the chunks' texts.
    one = chunks.select("content_hash", "content", "embedding").limit(5).dropDuplicates(["content_hash"])
    again = {r.content_hash: r.embedding for r in embedding.hash_embed(one, "content_hash", "content", 32).collect()}
    assert all(r.embedding == again[r.content_hash] for r in one.collect())


def test_a_batch_that_runs_twice(spark, tmp_path):
    at = str(tmp_path / "s")
    run(spark, at, files(), 2)
    before = told(spark, at)
    shutil.rmtree(f"{at}/state")  # as if no batch had been committed
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    jobs.reindex(stream, f"{at}/out", f"{at}/state", 32, ["the"]).awaitTermination()
    assert told(spark, at) == before


def test_retired_repositories_leave_the_statistics(spark, tmp_path):
    rows = files()
    run(spark, str(tmp_path / "all"), rows, 2)
    run(spark, str(tmp_path / "rest"), [r for r in rows if r[0] != "r1"], 1)
    jobs.retire(spark, str(tmp_path / "all" / "out"), spark.createDataFrame([("r1",)], "repo_id string"), -1, ["the"])
    assert told(spark, str(tmp_path / "all")) == told(spark, str(tmp_path / "rest"))


def test_no_batches(spark, tmp_path):
    assert jobs.statistics(spark, str(tmp_path))[1].first() == (0, 0) and jobs.statistics(spark, str(tmp_path))[0].where(F.lit(True)).count() == 0


def test_windows_expire_from_the_state(spark, tmp_path):
    minute = 60_000_000
    batches = [[(1, 1, 0), (2, 1, 5), (3, 2, 7), (4, 1, 9)], [(5, 3, 10 * minute)], [(6, 3, 10 * minute + 1)], [(7, 1, 20 * minute), (8, 3, 20 * minute)], [(9, 4, 21 * minute)]]
    for b, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id long, key long, t long").select("id", "key", F.timestamp_micros(F.col("t") + 10**15).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    held = spark.conf.get(jobs.ROCKSDB[0], None)
    spark.conf.set(*jobs.ROCKSDB)
    try:
        stream = spark.readStream.schema("id long, key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = jobs.rate_limit(stream, 2, minute).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    finally:
        spark.conf.set(jobs.ROCKSDB[0], held) if held else spark.conf.unset(jobs.ROCKSDB[0])
    got = {r.id: (r.allowed, r.remaining) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (True, 1), 2: (True, 0), 3: (True, 1), 4: (False, 0), 5: (True, 1), 6: (True, 0), 7: (True, 1), 8: (True, 1), 9: (True, 1)}
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert min(kept[2:]) < max(kept[:2]), kept  # windows of minute 0 are gone once the watermark has passed them
