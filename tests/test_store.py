"""Tables written in place, and passes of any budget."""

from __future__ import annotations

import glob
import os
import random

import pytest

from corpusmill.operators import chunk_store as P

CHUNKS = "repo_id string, path string, start_line long, content_hash string, content string"


def rows(seed=0, repos=("a/x", "b/y", "big"), n=12):
    rng = random.Random(seed)
    return [(r, f"f{k % 3}.py", k, f"h{rng.randint(0, 30)}", f"def part_{k}(x): return {k}") for r in repos for k in range(n * (3 if r == "big" else 1))]


def files(store):
    return set(glob.glob(os.path.join(store.path.removeprefix("file://"), "**", "*.parquet"), recursive=True))


def content(store):
    return sorted((r.repo_id, r.content_hash, r.embed_model, tuple(r.embedding or ())) for r in store.read().collect())


def test_passes_of_any_budget_end_alike(spark, tmp_path):
    first, second = spark.createDataFrame(rows(1), CHUNKS), spark.createDataFrame(rows(2, ("a/x", "big")), CHUNKS)
    ends = []
    for budget in (1000, 7, 3):
        store = P.ChunkStore(spark, str(tmp_path / f"s{budget}"))
        passes = [P.index_all(store, df, "m1", budget, 16, str(tmp_path / f"t{budget}-{k}")) for k, df in enumerate((first, second))]
        assert passes == [1, 1] if budget == 1000 else passes[0] > 2
        ends.append(content(store))
        assert all(any(v) for *_, v in ends[-1])
    assert ends[0] == ends[1] == ends[2]
    hashes = {(r, h) for r, h, *_ in ends[0]}
    assert hashes == {(r[0], r[3]) for r in rows(2, ("a/x", "big"))} | {(r[0], r[3]) for r in rows(1) if r[0] == "b/y"}
    assert len(ends[0]) == len(hashes)


def test_a_stopped_run_goes_on(spark, tmp_path):
    store, df = P.ChunkStore(spark, str(tmp_path / "s")), spark.createDataFrame(rows(1), CHUNKS)
    told = {r.repo_id: r for r in P.index_pass(store, df, "m1", 5, 16, str(tmp_path / "1")).collect()}
    held = {(r.repo_id, r.content_hash) for r in store.read().collect()}
    assert all(r.status == "indexing" and r.embedded == 5 for r in told.values()) and len(held) == 15
    before = files(store)
    again = {r.repo_id: r for r in P.index_pass(store, df, "m1", 5, 16, str(tmp_path / "2")).collect()}
    assert before <= files(store)  # nothing is rewritten while chunks remain
    assert all(again[r].remaining == max(told[r].remaining - 5, 0) for r in told)
    assert held < {(r.repo_id, r.content_hash) for r in store.read().collect()}


def test_a_new_model_replaces_only_when_done(spark, tmp_path):
    store, df = P.ChunkStore(spark, str(tmp_path / "s")), spark.createDataFrame(rows(1, ("a/x",)), CHUNKS)
    P.index_all(store, df, "m1", 100, 16, str(tmp_path / "t1"))
    old = content(store)
    P.index_pass(store, df, "m2", 3, 16, str(tmp_path / "t2"))
    assert [x for x in content(store) if x[2] == "m1"] == old and sum(x[2] == "m2" for x in content(store)) == 3
    P.index_all(store, df, "m2", 3, 16, str(tmp_path / "t3"))
    assert [(a, b, c) for a, b, _, c in content(store)] == [(a, b, c) for a, b, _, c in old] and {x[2] for x in content(store)} == {"m2"}


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    store, df = P.ChunkStore(spark, str(tmp_path / "s")), spark.createDataFrame(rows(1), CHUNKS)
    P.index_all(store, df, "m", 100, 8, str(tmp_path / "t1"))
    before = files(store)
    gone = min(h for r, h, *_ in content(store) if r == "big")
    less = df.where(f"repo_id = 'big' AND content_hash <> '{gone}'")
    P.index_all(store, less, "m", 100, 8, str(tmp_path / "t2"))
    lost = {os.path.dirname(f) for f in before - files(store)}
    assert len(lost) == 1 and "repo_id=big" in lost.pop()
    assert ("big", gone) not in {(r, h) for r, h, *_ in content(store)} and len(content(store)) == len({(r[0], r[3]) for r in rows(1)}) - 1
    # A folder whose rows all go is deleted.
    P.index_all(store, df.where("repo_id = 'big'").limit(1), "m", 100, 8, str(tmp_path / "t3"))
    assert sum(r == "big" for r, *_ in content(store)) == 1
    kept = files(store)
    store.delete(spark.createDataFrame([("a/x",), ("nowhere",)], "repo_id string"))
    assert {r for r, *_ in content(store)} == {"b/y", "big"} and {f for f in kept if "repo_id=a%2Fx" not in f} == files(store)


def test_upserts_rewrite_parts(spark, tmp_path):
    held = spark.createDataFrame([(str(k), f"n{k}", "ready", k) for k in range(40)], "id string, name string, status string, created_at int")
    store = P.RepoStore(spark, str(tmp_path / "r"), held.schema)
    assert store.read().count() == 0
    store.append(held)
    before = files(store)
    store.upsert(spark.createDataFrame([("3", None, "error"), ("new", "n", "indexing")], "id string, name string, status string"))
    got = {r.id: (r.name, r.status, r.created_at) for r in store.read().collect()}
    assert got["3"] == ("n3", "error", 3) and got["new"] == ("n", "indexing", None) and len(got) == 41
    assert 0 < len(before - files(store)) <= 2
    store.upsert(spark.createDataFrame([("3", "again", None)], "id string, name string, status string"))
    assert {r.id: (r.name, r.status) for r in store.read().collect()}["3"] == ("again", "error")


@pytest.mark.parametrize("parts", [1, 8])
def test_inserts_twice_add_nothing(spark, tmp_path, parts):
    df = spark.createDataFrame(rows(3), CHUNKS)
    store = P.ChunkStore(spark, str(tmp_path / "s"), df.schema, parts)
    store.insert(df, ["path", "start_line"])
    n, kept = store.read().count(), files(store)
    store.insert(df, ["path", "start_line"])
    assert store.read().count() == n == len({(r[0], r[3]) for r in rows(3)}) and kept <= files(store)
