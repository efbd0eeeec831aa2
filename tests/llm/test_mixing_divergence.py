"""Context mixing against word-at-a-time sums and a proof that its probabilities sum to one; divergence against plain loops."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import op12_mixing, op13_divergence
from corpusmill.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string"
WORDS = ["the", "of", "and", "Sea", "gull", "harbour", "ship", "crew", "storm", "rope", "çà", "naïve"]


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(words[-1][::-1] if words and rng.random() < 0.3 else rng.choice(WORDS) if rng.random() < 0.8 else f"w{rng.randint(0, 300)}")
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), rng.choice(["en", "fr"]), f"s{rng.randint(0, 4)}"))
    return rows + [(300, None, None, None), (301, "", "en", None), (302, "solo " * 30_000, "en", "s1"), (303, "x" * 700_000, "de", ""), (None, "the sea", "en", "s1"), (5, rows[5][1], "en", "s2")]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def base_of(rows, held):
    train = [tokens(t) for i, t, *_ in rows if i is not None and not held(i)]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()) + len(train), len(count) + 1
    out = []
    for i, t, *_ in rows:
        c = [count[w] for w in tokens(t)] + [len(train)]
        out.append((i, len(c), sum(x > 0 for x in c), round(sum(math.log10((x + 1) / (n + v + 1)) for x in c), 5)))
    return sorted(out, key=repr), n


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_mixing_query_and_join_of_rare_words(spark, prose, tmp_path):
    df = spark.createDataFrame([(*r, "own", "own") for r in prose], SCHEMA + ", row string, lost string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    wanted, n = base_of(prose, held)
    got = QUERIES["op12_mixing"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got), key=repr) == wanted
    assert all(r.train_tokens == n and r.held_out == (r.doc_id is not None and held(r.doc_id)) and r.score < 0 for r in got)
    asked = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in asked) > sum(r.base_score for r in asked)
    # All but a few words only by a join: the same sums, and a model of the same quality.
    train = df.where("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")
    few = {r.doc_id: r for r in op12_mixing.score(df, op12_mixing.fit(train, model_words=9)).collect()}
    for r in got:
        f = few[r.doc_id]
        assert (f.n_tokens, f.n_known) == (r.n_tokens, r.n_known) and abs(f.base_score - r.base_score) < 1e-6 * (1 + abs(r.base_score))
    again = {(r.doc_id, r.score) for r in op12_mixing.score(df.repartition(7), op12_mixing.fit(train.repartition(5))).collect()}
    assert {k: round(v, 2) for k, v in again} == {r.doc_id: round(r.score, 2) for r in got}


def test_probabilities_sum_to_one(spark):
    """Over all texts of up to seven words, of three known ones and one unknown kind, as longer ones hold little."""
    rows = [(i, " ".join(random.Random(i).choices(["a", "b", "b", "c"], k=i % 4)), "", "") for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    for most in (2_000_000, 2):
        model = op12_mixing.fit(df, model_words=most)
        mass = []
        for size in range(8):
            texts = [" ".join(t) for t in itertools.product(["a", "b", "c", "zz"], repeat=size)]
            got = op12_mixing.score(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), model).collect()
            mass.append(sum(10**r.score for r in got))
        assert 0.97 < sum(mass) <= 1 + 1e-6, mass


def test_mixing_learns_online():
    """A text whose bits the weights get wrong costs less with a rate than without."""
    rng = np.random.default_rng(1)
    s = {"bit": np.ones(5000, np.int8), "said": np.full(5000, -1, np.float32), "gate": np.zeros(5000, np.int64), "slots": [rng.integers(0, 8, 5000)] * 3, "edges": np.array([0, 4000, 5000])}
    said, w = np.zeros((3, 8), np.float16), np.tile(np.array([1, 0, 0, 0, 0], np.float32), (op12_mixing.GATES, 1))
    plain, learned = (op12_mixing.mixed(s, said, w, rate) for rate in (0.0, 0.01))
    assert np.allclose(plain, np.array([4000, 1000]) * math.log2(1 + math.e), rtol=1e-4) and (learned < 0.6 * plain).all()


def test_codes_are_prefix_free():
    for counts in ([1, 1], [5, 1, 1, 9, 0, 3], [2**k for k in range(45)]):
        code = op12_mixing.Code(np.array(counts))
        spans = sorted((int(b), int(b) + (1 << (32 - int(n)))) for b, n in zip(code.bits, code.lengths))
        assert spans[0][0] == 0 and spans[-1][1] == 1 << 32 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_mixing_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = op12_mixing.fit(none)
    assert op12_mixing.score(none, model).count() == 0
    (r,) = op12_mixing.score(spark.createDataFrame([(1, "a b", "", "")], SCHEMA), model).collect()
    assert (r.n_tokens, r.n_known, r.base_score) == (3, 0, 0.0) and r.score < 0


def plain_divergence(rows, least=3, top=200):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))) for _, t, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, c in mine for w in c)
        kept = sorted(w for w in df if df[w] >= least)
        groups = {s: Counter() for _, s, _ in mine}
        for _, s, c in mine:
            groups[s] += Counter({w: c[w] for w in kept if c[w]})
        whole = sum(groups.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        shares, q = {s: p(c) for s, c in groups.items()}, p(whole)
        for s in groups:
            pairs = [(-sum(f(shares[s][w], shares[o][w]) for w in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-f(shares[s][w], q[w]), w.encode(), w) for w in kept if groups[s][w] and shares[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)}
    return out


def test_divergence(spark, prose, monkeypatch):
    df = spark.createDataFrame([(*r, "own") for r in prose], SCHEMA + ", term string").repartition(3)
    got = [tuple(r) for r in op13_divergence.divergence(df).collect()]
    assert set(got) == plain_divergence(prose) and len(got) == len(set(got))
    assert {tuple(r) for r in op13_divergence.divergence(df, least=1, top=4).collect()} == plain_divergence(prose, 1, 4)
    assert op13_divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_divergence_in_small_walks_and_with_huge_counts():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 3, (6, 37))
    counts[3], counts[4] = counts[2], 0
    forest = op13_divergence.Forest(counts)
    assert forest.roots[2] == forest.roots[3]
    edge, x, y, times = forest.meet(forest.roots[[0, 2, 4]], forest.roots[[1, 3, 4]])
    for k, (a, b) in enumerate(((0, 1), (2, 3), (4, 4))):
        here = slice(edge[k], edge[k + 1])
        assert Counter(zip(counts[a].tolist(), counts[b].tolist())) == {(int(p), int(q)): int(t) for p, q, t in zip(x[here], y[here], times[here])}
    huge = np.array([10**13, 10**10, 0])
    assert op13_divergence.shares(huge, 10**14, 5).tolist() == [1 + 10**9 * (int(c) + 1) // (10**14 + 5) for c in huge]
    few = op13_divergence._prices
    import pandas as pd

    block = pd.DataFrame({"lang": "x", "source": ["a", "b", "b", "c"], "idx": [1, 1, 2, 2], "n": [4, 4, 1, 9]})
    groups = pd.DataFrame({"source": list("abcde"), "total": [4, 5, 9, 0, 0], "terms": 2})
    wide = few(block, groups)
    op13_divergence.WALK_CELLS, held = 2, op13_divergence.WALK_CELLS
    try:
        assert few(block, groups).equals(wide)
    finally:
        op13_divergence.WALK_CELLS = held
