"""The build of the stored index: no shuffle of postings, ranges within their size."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from corpusmill.operators import embedding, index_store


def test_postings_are_made_where_documents_are_read(spark):
    rows = [(i, sum(c.values()), list(c), list(c.values())) for i in range(300) if (c := Counter(f"w{(i * k) % 17}" for k in range(1, 2 + i % 40)))]
    docs = spark.createDataFrame(rows, "chunk_id long, dl long, terms array<string>, tfs array<int>").repartition(3)
    made = index_store.blocks_of(docs, 10.0, range_docs=8)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = made.collect()
    assert {(d.chunk_id, r.term, d.tf) for r in got for d in r.docs} == {(i, t, n) for i, _, ts, ns in rows for t, n in zip(ts, ns)}
    assert len({(r.term, r.range) for r in got}) == len(got) and sum(r.n for r in got) == sum(len(ts) for _, _, ts, _ in rows)
    held = {}
    for r in got:
        held.setdefault(r.range, set()).update(d.chunk_id for d in r.docs)
        assert r.most_tf == max(d.tf for d in r.docs) and [d.chunk_id for d in r.docs] == sorted(d.chunk_id for d in r.docs)
        assert abs(r.most_gain - max(index_store.gains(float(d.tf), d.dl, 10.0) for d in r.docs)) < 1e-12
    assert max(map(len, held.values())) == 8 and sum(map(len, held.values())) == 300


def test_texts_are_taken_apart_once(spark, tmp_path):
    odd = ["", None, "İstanbul K_KİAb fooBar HTTPServer x_y__z _ __ a", "ÀÉabc1DEFg22h the cats Cat CATS ponies sKies", "snake_case_word CamelCaseX9y " * 300, "aΣ ſtraße ABCs Z z9 THE_cats"]
    texts = spark.createDataFrame(list(enumerate(odd)), "chunk_id long, text string").coalesce(1)
    index = index_store.build(texts, "text", str(tmp_path / "index"), ["the"], dim=16)
    assert {p.name for p in (tmp_path / "index").iterdir()} == {"documents", "postings", "stats"}  # one pass over the texts
    plain = {r.chunk_id: (r.dl, dict(zip(r.terms, r.tfs))) for r in index_store.term_counts(texts, "text", ["the"]).collect()}
    assert {r.chunk_id: (r.dl, dict(zip(r.terms, r.tfs))) for r in index.documents.collect()} == plain
    wanted = {}
    for k, text in enumerate(odd):  # by the definition, feature by feature
        found, sums = embedding.text_tokens(text or ""), [0.0] * 16
        features = [("w:" + t, 20) for t in found] + [(f"b:{a}_{b}", 12) for a, b in zip(found, found[1:])]
        features += [("c:" + f"^{t}$"[i : i + n], 7) for t in found if len(t) >= 3 for n in (3, 4, 5) for i in range(len(t) + 3 - n)]
        for feature, weight in features:
            h = 2166136261
            for byte in feature.encode():
                h = ((h ^ byte) * 16777619) & 0xFFFFFFFF
            sums[h % 16] += -weight if h & 65536 else weight
        wanted[k] = sums
    assert {r.chunk_id: list(r.embedding) for r in index.vectors.collect()} == wanted


def test_a_search_reads_the_postings_once(spark, tmp_path):
    texts = [(i, " ".join(f"w{(i * k) % 37}" for k in range(1, 4 + i % 50))) for i in range(400)]
    index = index_store.build(spark.createDataFrame(texts, "chunk_id long, text string").repartition(3), "text", str(tmp_path / "index"), [], range_docs=8)
    terms = spark.createDataFrame([(q, f"w{t}") for q, ts in ((1, (3, 5)), (2, (7, 5, 36)), (3, (99,))) for t in ts], "query_id long, term string")
    for bm25 in (False, True):
        found = index_store.topk(terms, index, 5, bm25)
        read = {f.rsplit("/", 2)[-2] for f in found.inputFiles()}
        assert "postings" not in read and read  # bounds, probes and scores read the asked blocks, which were found in one reading
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in found.collect()}
        every = index_store._scored(terms.withColumn("idf", F.lit(1.0)), None, index.postings, index, False, None, True).collect() if not bm25 else None
        if every:  # against all scores, without bounds
            for q in (1, 2):
                best = sorted(((-r.score, r.chunk_id) for r in every if r.query_id == q))[:5]
                assert [got[q, n + 1] for n in range(5)] == [(i, -s) for s, i in best]
    blocks = index_store.chosen_ranges(terms, index, 5, False)[1]
    assert {r.term for r in blocks.collect()} == {"w3", "w5", "w7", "w36"} and "w99" not in {r.term for r in index.postings.collect()}
