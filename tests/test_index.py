"""The stored index: hashed embeddings, blocks of postings and pruning, against plain loops over every document."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import columns as C
from corpusmill.operators import embedding, index_store, retrieval

STOP = ["the", "of"]


def fnv(text):
    h = C.FNV_START
    for byte in text.encode():
        h = ((h ^ byte) * C.FNV_PRIME) & C.MASK_32
    return h


def plain_sums(text, dim):
    found = embedding.text_tokens(text or "")
    weights = Counter()
    for t in found:
        weights[f"w:{t}"] += 20
        for n in (3, 4, 5):
            framed = f"^{t}$"
            for i in range(len(framed) - n + 1 if len(t) >= 3 else 0):
                weights[f"c:{framed[i : i + n]}"] += 7
    for a, b in zip(found, found[1:]):
        weights[f"b:{a}_{b}"] += 12
    out = np.zeros(dim)
    for feature, w in weights.items():
        h = fnv(feature)
        out[h % dim] += -w if h & 65536 else w
    return out


TEXTS = ["parse the userToken and user_token HTTPServer2 x", "", None, "a a a", "É çà sea", "snake_case_name _x_ __", "z" * 3000 + " tail", "Kelvin K and İstanbul", "same same_same"]


@pytest.mark.parametrize("dim", [64, 1536])
def test_embedding_in_one_pass(spark, dim):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string").repartition(2)
    got = embedding.bucket_vectors(df, "k", "text", dim)
    assert "Exchange" not in embedding.bucket_vectors(spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string"), "k", "text", dim)._jdf.queryExecution().executedPlan().toString()
    rows = {r.k: r.embedding for r in got.collect()}
    for k, text in enumerate(TEXTS):
        assert np.array_equal(rows[k], plain_sums(text, dim)), k
    tokens = {r.k: r.t for r in df.where("text IS NOT NULL").select("k", C.code_tokens(F.col("text")).alias("t")).collect()}
    assert all(embedding.text_tokens(TEXTS[k]) == t for k, t in tokens.items())
    unit = {r.k: r.embedding for r in embedding.hash_embed(df, "k", "text", dim).collect()}
    assert abs(np.linalg.norm(unit[0]) - 1) < 1e-5 and not any(unit[1]) and not any(unit[2])


def test_embedding_forgets_and_goes_on(spark, monkeypatch):
    monkeypatch.setattr(embedding, "REMEMBERED", 3)
    monkeypatch.setattr(embedding, "CELLS", 128)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string").coalesce(1)
    run = {r.k: r.embedding for r in embedding.bucket_vectors(df, "k", "text", 64).collect()}
    assert all(np.array_equal(run[k], plain_sums(t, 64)) for k, t in enumerate(TEXTS))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice(['rs', 'ties', 'x', 'ses', 'lm'])}" for _ in range(60)] + STOP
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40) if rng.random() < 0.9 else 400)) for _ in range(500)] + [None, "", "the of"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    asked = {q: {index_store.stemmed(w) for w in rng.sample(words[:60], rng.randint(1, 4))} for q in range(12)} | {12: {"nowhere"}}
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string")
    return df, dict(enumerate(texts)), asked, terms, index_store.build(df, "text", str(tmp_path_factory.mktemp("index") / "i"), STOP, 64, range_docs=8)


def counts(text):
    return Counter(index_store.stemmed(w) for w in index_store.WORDS.findall((text or "").lower()) if w not in STOP)


def plain_topk(texts, asked, k, bm25):
    docs = {i: c for i, t in texts.items() if (c := counts(t))}
    avg = sum(sum(c.values()) for c in docs.values()) / len(docs)
    out = {}
    for q, terms in asked.items():
        scored = []
        for i, c in docs.items():
            if not any(c[t] for t in terms):
                continue
            s = sum(c[t] for t in terms) / 10
            if bm25:
                s = 0.0
                for t in terms:
                    df = sum(t in d for d in docs.values())
                    s += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) if c[t] else 0.0
            scored.append((-round(s, 9), i))
        out |= {(q, i): (n + 1, -s) for n, (s, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("bm25", [False, True])
def test_pruned_search_is_whole(stored, bm25):
    _, texts, asked, terms, index = stored
    for k in (1, 5, 30):
        got = {(r.query_id, r.chunk_id): r for r in index_store.topk(terms, index, k, bm25).collect()}
        wanted = plain_topk(texts, asked, k, bm25)
        assert set(got) == set(wanted)
        assert all(got[key].rank == rank and abs(got[key].score - s) < 1e-8 for key, (rank, s) in wanted.items())
    assert index_store.skipped(terms, index, 1, bm25) > 0.1  # gains of BM25 are much alike, so less is skipped than by plain counts
    assert bm25 or index_store.skipped(terms, index, 5) > 0.3


def test_search_within_a_part(spark, stored):
    df, texts, asked, terms, index = stored
    odd = df.where("chunk_id % 2 = 1")
    got = {(r.query_id, r.chunk_id): r.rank for r in index_store.topk(terms, index, 6, within=odd).collect()}
    assert got == {key: rank for key, (rank, _) in plain_topk({i: t for i, t in texts.items() if i % 2}, asked, 6, False).items()}


def test_index_tables(stored):
    _, texts, _, _, index = stored
    full = {i for i, t in texts.items() if counts(t)}
    assert index.stats["n"] == len(full) and index.vectors.count() == len(texts) == index.documents.count()
    rows = index.postings.collect()
    assert max(r.n for r in rows) <= 40 and all(r.most_tf == max(d.tf for d in r.docs) for r in rows)
    assert sum(r.n for r in rows) == sum(len(counts(t)) for t in texts.values()) == index.stats["postings"]


def test_an_empty_index(spark, tmp_path):
    index = index_store.build(spark.createDataFrame([], "chunk_id long, text string"), "text", str(tmp_path / "none"), STOP, 16)
    terms = spark.createDataFrame([(1, "a")], "query_id long, term string")
    assert index_store.topk(terms, index, 3, True).count() == 0 and index_store.skipped(terms, index, 3) == 0


def test_equal_rows_leave_a_task_as_k_each(spark):
    c = spark.createDataFrame([(i, [1.0, 0.0] if i % 4 else [float(i), 1.0]) for i in range(4000)], "chunk_id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(5)], "query_id long, embedding array<float>")
    near = retrieval.nearest(q, c, 7)
    assert near.count() <= 4 * 5 * 7
    got = {(r.query_id, r.rank): r.chunk_id for r in retrieval.top(near, "similarity", 7).collect()}
    ids = [i for i in range(4000) if i % 4]
    assert [got[0, n] for n in range(1, 8)] == ids[:7]


def test_lookups_compare_few_pairs(spark):
    """At the threshold of the cache, on questions that come in groups, as whole as all pairs and from a fifth of them."""
    from corpusmill.operators import cache

    rng = np.random.default_rng(4)
    topics = rng.normal(size=(60, 32))
    rows = [(i, i % 2, "m", [float(x) for x in topics[i % 60] + 0.12 * rng.normal(size=32)]) for i in range(3000)]
    rows += [(5000, 0, "m", None), (5001, 0, "m", [0.0] * 32), (5002, None, "m", [1.0] * 32)]
    df = spark.createDataFrame(rows, "id long, repo_id int, embed_model string, embedding array<float>").repartition(4)
    asked, held = df.where("id % 7 = 0").withColumnRenamed("id", "question_id"), df.where("id % 7 <> 0")
    met = spark.sparkContext.accumulator(0)
    got = {r.question_id: (r.cached_id, r.similarity) for r in cache.lookup(asked, held, met=met).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, _, v in rows if v and any(v)}
    repo = {i: r for i, r, _, _ in rows}
    pairs = 0
    for i in [i for i, *_ in rows if i % 7 == 0]:
        best = (None, None)
        if i in unit and repo[i] is not None:
            ids = [c for c in unit if c % 7 and repo[c] == repo[i]]
            pairs += len(ids)
            alike = np.round(np.array([unit[c] for c in ids], np.float32).astype(float) @ unit[i], 6)
            if alike.max() >= 0.92:
                best = (None, float(alike.max()))
        assert (got[i][1] is None) == (best[1] is None) and (best[1] is None or abs(got[i][1] - best[1]) < 1e-5), i
    assert sum(v[0] is not None for v in got.values()) > 400 and 0 < met.value < 0.2 * pairs
