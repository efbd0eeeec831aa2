"""Texts of more than a slice as a bucket's guest, null and repeated ids, and batches of one and two rows."""

from __future__ import annotations

import hashlib
import random

import pytest

from corpusmill.llm import op2_language, op5_fingerprints

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        n = len(t) // 4
        new = t[: len(t) - n] + rows[(k + 1) % len(rows)][1][:n]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out, key=repr)


def long_text(seed, size):
    rng = random.Random(seed)
    return " ".join(rng.choice(["sea", "gull", "çà", "rope\n"]) + str(rng.randint(0, 99)) for _ in range(size // 7))[:size]


@pytest.mark.parametrize("batch", ["1000", "2", "1"])
@pytest.mark.parametrize("case", ["unique", "nulls"])
def test_long_guests(spark, batch, case):
    if case == "unique":
        rows = [(i, long_text(i, 600_000)) for i in range(30)]
    else:
        rows = [(None, long_text(0, 2_000_000)), (None, "a b"), (1, None), (1, "c d e"), (2, ""), (7, long_text(1, 700_000)), (7, long_text(1, 700_000)), (9, "last one")]
    held = spark.conf.get(KEY)
    spark.conf.set(KEY, batch)
    try:
        got = op5_fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        spark.conf.set(KEY, held)
    assert sorted(((r.id, r.n_chars, r.edited_sha256) for r in got), key=repr) == edits(rows)
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)


def test_every_language_can_be_predicted(spark):
    """Three hundred labels, each with words of its own."""
    rng = random.Random(6)
    sounds = [a + b + c for a in "bcdfghklmn" for b in "aeiou" for c in "prstvz"]
    rows = [(k * 4 + n, " ".join(rng.choice(sounds[k % 300 :: 300] + [sounds[k % 300] + x for x in ("ab", "ec", "id", "of")]) for _ in range(12)), f"l{k:03d}") for k in range(300) for n in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r.lang_pred for r in op2_language.identify(df, op2_language.fit(df)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.95 * len(rows) and len(set(got.values())) > 280
