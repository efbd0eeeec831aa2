"""Many passes are few jobs."""

from __future__ import annotations

from corpusmill.operators import chunk_store as P


def test_many_passes_are_few_rounds(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("a/x", f"f{k}.py", k, f"h{k}", f"def part_{k}(x): return {k}") for k in range(41)], "repo_id string, path string, start_line long, content_hash string, content string")
    budgets, one = [], P.index_pass
    monkeypatch.setattr(P, "index_pass", lambda store, rows, model, budget, *more: budgets.append(budget) or one(store, rows, model, budget, *more))
    store = P.ChunkStore(spark, str(tmp_path / "s"))
    assert P.index_all(store, df, "m", 2, 8, str(tmp_path / "t")) == 21
    assert budgets == [2, 8, 32]  # 21 passes in three rounds
    assert sorted(r.content_hash for r in store.read().collect()) == sorted(f"h{k}" for k in range(41))
