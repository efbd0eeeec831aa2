"""Texts move once through a shuffle, however many rounds follow; rows are picked by bits of their numbers."""

from __future__ import annotations

import random
import string

from pyspark.sql import functions as F

from corpusmill.operators import chunk_store as P


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    told = sc.statusStore().executorList(False)
    return sum(told.apply(k).totalShuffleWrite() for k in range(told.size()))


def test_texts_are_shuffled_once(spark, tmp_path):
    rng = random.Random(5)
    rows = [(r, f"f{k:03}.md", k, f"{r}{k}", "".join(rng.choices(string.ascii_letters + string.digits, k=8000))) for r in ("a/x", "b/y", "big") for k in range(400 if r == "big" else 60)]
    spark.createDataFrame(rows, "repo_id string, path string, start_line long, content_hash string, content string").write.parquet(str(tmp_path / "in"))
    df, size = spark.read.parquet(str(tmp_path / "in")), sum(len(r[4]) for r in rows)
    store, start = P.ChunkStore(spark, str(tmp_path / "s")), shuffled(spark)
    assert P.index_all(store, df, "m1", 10, 16, str(tmp_path / "t1")) == 40  # in four rounds
    first = shuffled(spark)
    assert first - start < 1.5 * size
    assert P.index_all(store, df.where("start_line % 2 = 0"), "m2", 10, 16, str(tmp_path / "t2")) == 20
    assert shuffled(spark) - first < 0.75 * size
    assert {(r.repo_id, r.start_line, r.content, r.embed_model) for r in store.read().collect()} == {(*(r[k] for k in (0, 2, 4)), "m2") for r in rows if r[2] % 2 == 0}


def test_bits_pick_exactly_the_numbers(spark):
    edges = {0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 65537, (5 << 33), (5 << 33) + 1, (5 << 33) + 32768}
    rng = random.Random(1)
    every = sorted({n + k for n in edges for k in range(-2, 3) if n + k >= 0} | {rng.randrange(100_000) for _ in range(2000)})
    some = [n for n in every if n in edges or rng.random() < 0.3]
    frame = lambda ns: spark.createDataFrame([(n, who) for n in ns for who in "ab"], "row long, who string")
    bits = P.bitmaps(frame(some).where("who = 'a'"), "row", ["who"])
    got = P.with_bit(frame(every), "row", bits, ["who"]).where("bit").select("row", "who").collect()
    assert sorted(tuple(r) for r in got) == [(n, "a") for n in some]


def test_chunks_of_any_number_keep_their_order(spark, tmp_path):
    """Passes take chunks by path, line and hash over the borders of sorting tasks, too."""
    rng = random.Random(2)
    rows = [(r, f"f{rng.randrange(9)}.py", rng.randrange(50), f"{r}{k}", f"def f_{k}(x): return {k}") for r in ("a/x", "b/y", "big") for k in range(900 if r == "big" else 40)]
    df = P.staged(spark.createDataFrame(rows, "repo_id string, path string, start_line long, content_hash string, content string").repartition(7), str(tmp_path / "in"))
    held = P.ChunkStore(spark, str(tmp_path / "s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        new, counts = P._new(held, df, "m", str(tmp_path / "new"))
        got = {(r.repo_id, r.content_hash): r.nth for r in new.join(df, ["repo_id", "row"]).collect()}
        tasks = spark.read.parquet(str(tmp_path / "new/sorted")).where("repo_id = 'big'").select(F.shiftright("seq", 33).alias("task")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
    for repo in ("a/x", "b/y", "big"):
        assert [got[x[0], x[3]] for x in sorted(r for r in rows if r[0] == repo)] == list(range(1, sum(r[0] == repo for r in rows) + 1))
    assert {r.repo_id: r.new for r in counts.collect()} == {"a/x": 40, "b/y": 40, "big": 900}


def test_chunks_of_no_repository_are_embedded_once(spark, tmp_path):
    rows = [(r, f"f{k:02}.py", k, f"h{k}", f"def part_{k}(x): return {k}") for r in (None, "a/x") for k in range(25)]
    store, df = P.ChunkStore(spark, str(tmp_path / "s")), spark.createDataFrame(rows[:-20], "repo_id string, path string, start_line long, content_hash string, content string")
    assert P.index_all(store, df, "m", 3, 8, str(tmp_path / "t")) == 9
    assert sorted((r.repo_id or "", r.content_hash) for r in store.read().collect()) == sorted((r[0] or "", r[3]) for r in rows[:-20])
