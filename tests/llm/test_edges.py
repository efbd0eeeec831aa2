"""Nulls, repeated ids, clashing columns, very long texts and the registered queries of the training-text operators."""

from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import op1_substring_dedup, op2_language, op3_quality, op4_bpe, op5_fingerprints, op6_toxicity, op7_packing, op8_html, op9_ngram_join, op10_exact_dedup
from corpusmill.llm.queries import QUERIES

#: Names that the operators use on their way.
CLASHING = ["row", "_row", "__row", "spans", "__spans", "score", "n_sentences", "n_removed", "node", "key", "digest", "words", "log_ratios", "ratios", "lost", "comp", "size", "toxic", "calibrates", "w", "id", "kept"]


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(["ba", "ne", "tri", "lo", "qua"]) + rng.choice(["mi", "sor", "tek", "u"]) + rng.choice(["", "ra", "ni."]) for _ in range(words))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, nulls in every column, ties, a text of over 1 MB and its copy, and clashing columns."""
    rng = random.Random(3)
    long = prose(rng, 200_000)
    texts = [prose(rng, rng.randint(1, 80)) for _ in range(40)]
    rows = [*enumerate(texts), (3, texts[3]), (3, "another text with the same id"), (None, texts[5]), (None, None), (None, ""), (41, long), (42, long), (43, None), (44, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, "de"))
    for c in CLASHING:
        df = df.withColumn(c, F.lit("own"))
    return df.repartition(3).cache()


def keeps_columns(out, odd, n=None):
    assert out.columns[: len(odd.columns)] == odd.columns
    rows = out.collect()
    assert all(r[c] == "own" for r in rows for c in CLASHING)
    assert n is None or len(rows) == n
    return rows


def test_columns_of_any_name(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    keeps_columns(op1_substring_dedup.substring_dedup(odd), odd, n)
    keeps_columns(op3_quality.score(odd, op3_quality.fit(odd, labels)), odd, n)
    keeps_columns(op6_toxicity.score(odd, op6_toxicity.fit(odd, labels, rows=20)), odd, n)
    keeps_columns(op6_toxicity.score(odd, op6_toxicity.fit(odd, labels, rows=20, model_words=5)), odd, n)
    first = keeps_columns(op10_exact_dedup.keep_first(odd), odd)
    # Id 3 stays with both of its texts; the null texts equal the empty ones, of which 43 is first.
    assert sorted(r.doc_id for r in first) == sorted([*range(40), 3, 41, 43])
    one = keeps_columns(op9_ngram_join.keep_one(odd), odd)
    assert {r.doc_id for r in one} >= {41, 43, 44} and 42 not in {r.doc_id for r in one}


def test_nulls_repeats_and_long_texts(spark, odd):
    n = odd.count()
    assert op2_language.identify(odd, op2_language.fit(odd)).count() == n
    enc = op4_bpe.encode(odd, op4_bpe.tokenizer_path())
    assert enc.count() == n
    back = {(r.doc_id, hash(r.text)) for r in op4_bpe.decode(enc, op4_bpe.tokenizer_path()).collect()}
    assert back == {(r.doc_id, hash(r.text or "")) for r in odd.select("doc_id", "text").collect()}
    prints = op5_fingerprints.edited(odd).collect()
    assert len(prints) == n and len({r.fingerprint for r in prints if r.n_chars > 1_000_000}) == 1
    pieces = op7_packing.pack(odd, op4_bpe.tokenizer_path("word_bpe_49k.json")).toPandas()
    assert (pieces.groupby("sequence_id").length.sum() <= 4096).all()
    same = {r.id: r for r in op9_ngram_join.jaccard_components(odd.where("doc_id > 3")).collect()}
    assert same[42].component_id == 41 and same[43].n_shingles == 0
    pages = spark.createDataFrame([(1, None, "<p>x" * 200_000, "a"), (1, "u", None, "b"), (None, "u", "", None)], "page_id long, url string, html string, section string")
    assert op8_html.extract(pages).count() == 3


def test_registered_queries_follow_their_contracts(spark, tmp_path):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        bad, rude = i % 4 == 1, i % 4 == 2
        text = " | ".join(prose(rng, 1) + "$$$" for _ in range(60)) if bad else prose(rng, 50) + (" vile filthy " if rude else " ") + prose(rng, 20)
        rows.append((i, text, "en", "s", len(text)))
        if i % 3 < 2:
            labels.append((i, int(not bad), int(rude)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    crc = {i: zlib.crc32(str(i).encode()) for i, *_ in rows}
    quality, toxic = ({i: v[k] for i, *v in labels} for k in (0, 1))
    for name, n, held, cut, truth in (("op3_quality", 5, 0, 0.3, quality), ("op6_toxicity", 3, 1, 0.7, toxic)):
        got = {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert set(got) == set(crc) and all(r.held_out == (crc[i] % n == held) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for i, r in got.items())
        asked = [i for i in truth if got[i].held_out]
        assert sum(got[i].predicted == truth[i] for i in asked) >= 0.9 * len(asked)
    got = QUERIES["op2_language"](spark, str(tmp_path)).collect()
    assert all(r.held_out == (crc[r.doc_id] % 4 == 2) and r.lang_pred == "en" for r in got) and len(got) == 400
