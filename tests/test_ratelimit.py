"""Rate limiting with a key spread over tasks, against one window walked through."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ratelimit as W


def walk(rows, limit, window):
    told, held = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        told[i] = held.setdefault(k, W.KeyWindow()).ask(t, limit, window)
    return told


def requests(seed, n=400):
    rng = random.Random(seed)
    rows, t = [], {1: -5000, 2: 0, 3: 10**6}
    for i in range(n):
        k = rng.choice([1, 2, 3])
        t[k] += rng.choice([0, 1, 3, 7, 40, 100, 101, 350])
        rows.append((i, k, t[k]))
    return rows + [(n + i, 4, 77) for i in range(50)] + [(2 * n, 5, 3), (2 * n + 1, 5, 103), (2 * n + 2, 5, 102)]


@pytest.mark.parametrize(("limit", "window"), [(1, 100), (3, 100), (4, 37), (2, 5000)])
def test_spread_out_is_the_walk(spark, tmp_path, limit, window):
    rows = requests(limit * window)
    df = spark.createDataFrame(rows, "id long, key long, t long").repartition(5)
    got = {r.id: (r.allowed, r.remaining, r.reset_in_us) for r in W.spread_out(df, limit, window, str(tmp_path / "w")).collect()}
    assert got == walk(rows, limit, window)


def test_hot_keys_are_told_apart(spark, tmp_path):
    rows = requests(9)
    df = spark.createDataFrame(rows, "id long, key long, t long").select("id", "key", F.timestamp_micros("t").alias("ts"))
    for hot in (10, 130, 10_000):
        out = W.replay(df, 3, 60, hot=hot, at=str(tmp_path / str(hot))).collect()
        assert {r.id: (r.allowed, r.remaining, r.reset_in_us) for r in out} == walk(rows, 3, 60) and len(out) == len(rows)


def test_a_key_of_a_million_requests_over_several_tasks(spark, tmp_path):
    df = spark.range(1_000_000).select("id", F.lit(7).cast("long").alias("key"), (F.col("id") * 13 % 5_000_011).alias("t"))
    out = W.spread_out(df, 5, 1000, str(tmp_path / "m"))
    out.write.parquet(str(tmp_path / "out"))
    done = spark.read.parquet(str(tmp_path / "out"))
    files = done.groupBy(F.input_file_name().alias("f")).count().collect()
    assert done.count() == 1_000_000 and len(files) > 1 and max(r["count"] for r in files) < 700_000
    rows = [(i, 7, i * 13 % 5_000_011) for i in range(1_000_000)]
    assert {r.id: (r.allowed, r.remaining, r.reset_in_us) for r in done.collect()} == walk(rows, 5, 1000)
