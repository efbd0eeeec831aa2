"""The training-text operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, op1_substring_dedup, op2_language, op3_quality, op4_bpe, op5_fingerprints, op6_toxicity, op7_packing, op8_html, op9_ngram_join, op10_exact_dedup, textvec
from corpusmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NASTY = ["", None, " ", "a", "\n\n", "word", "É è.", "x" * 3000, "don't 're  stop\n\tnow <|endoftext|> 12 ½ 😀", "the the the the the the. " * 30]


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(["ba", "ne", "tri", "lo", "qua"]) + rng.choice(["mi", "sor", "tek", "u"]) + rng.choice(["", "ra", "ni."]) for _ in range(words))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(5, 200)) for _ in range(60)]
    for k in range(12):
        words = texts[k].split()
        words[len(words) // 2] = "edited"
        texts.append(" ".join(words))
    texts += texts[:8] + [texts[0].replace(" ", "  ", 3)]
    passage = prose(rng, 70)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(4)] + NASTY
    rows = [(i, t, None if i % 9 == 0 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache(), {r[0]: r[1] for r in rows}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op1_substring_dedup.substring_dedup(empty).count() == 0
    assert op2_language.identify(empty, op2_language.fit(empty)).count() == 0
    assert op3_quality.score(empty, op3_quality.fit(empty, labels)).count() == 0
    assert op4_bpe.encode(empty, op4_bpe.tokenizer_path()).count() == 0
    assert op5_fingerprints.edited(empty).count() == 0
    assert op6_toxicity.score(empty, op6_toxicity.fit(empty, labels)).count() == 0
    assert op7_packing.pack(empty, op4_bpe.tokenizer_path("word_bpe_49k.json")).count() == 0
    assert op8_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert op9_ngram_join.jaccard_components(empty).count() == 0
    assert op10_exact_dedup.exact_dedup(empty).count() == 0


def test_bpe_is_the_library(corpus):
    from tokenizers import Tokenizer

    docs, texts = corpus
    path = op4_bpe.tokenizer_path()
    tok = Tokenizer.from_file(path)
    encoded = op4_bpe.encode(docs, path)
    back = {r.doc_id: r.text for r in op4_bpe.decode(encoded, path).collect()}
    for r in encoded.collect():
        want = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert back[r.doc_id] == tok.decode(want, skip_special_tokens=False) == (texts[r.doc_id] or "")


def test_special_tokens_of_one_text_and_of_two():
    import time

    from tokenizers import Tokenizer

    path = op4_bpe.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = ["a<|endof", "text|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y", "<|endoftext|>" * 20_000]
    start = time.process_time()
    ids, size = bpe.encode_texts(bpe.load(path), *textvec.text_views(pa.array(texts)))
    assert time.process_time() - start < 10
    for t, got in zip(texts, np.split(ids, np.cumsum(size)[:-1])):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_word_bpe_is_the_library():
    from tokenizers import Tokenizer

    path = op4_bpe.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(1)
    bits = ["A", "b", " ", "\n", "'s", "'LL", "12", "½", "é", "Σ", "İ", "😀", "--", "<|endoftext|>", "x" * 500, "ab" * 300]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(400)]
    ids, size = bpe.encode_normalised(bpe.load(path), texts)
    for t, got in zip(texts, np.split(ids, np.cumsum(size)[:-1])):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing(corpus):
    docs, texts = corpus
    rows = op7_packing.pack(docs, op4_bpe.tokenizer_path("word_bpe_49k.json"), width=128).toPandas()
    by_doc = rows.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert set(rows.doc_id) == set(texts)
    assert (by_doc.length.sum() == by_doc.doc_tokens.first()).all() and ((by_doc.length.cumsum() - rows.sort_values(["doc_id", "start"]).length) == rows.sort_values(["doc_id", "start"]).start).all()
    ordered = rows.sort_values(["sequence_id", "offset"])
    used = ordered.groupby("sequence_id").length
    assert (used.sum() <= 128).all() and (used.cumsum() - ordered.length == ordered.offset).all()
    assert used.sum().sum() / (128 * len(used)) > 0.9
    assert rows[rows.doc_id == [k for k, t in texts.items() if t == ""][0]].iloc[0].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())


def test_pack_histogram_places_everything():
    rng = random.Random(2)
    counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(40)}
    patterns = op7_packing.pack_histogram(counts, 64)
    placed: dict[int, int] = {}
    for pattern, n in patterns:
        assert sum(length * k for length, k in pattern) <= 64
        for length, k in pattern:
            placed[length] = placed.get(length, 0) + k * n
    assert placed == counts


def test_exact_dedup(spark, corpus):
    docs, texts = corpus
    key = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in texts.items()}
    first: dict[str, int] = {}
    size: dict[str, int] = {}
    for i in sorted(key):
        first.setdefault(key[i], i)
        size[key[i]] = size.get(key[i], 0) + 1
    for r in op10_exact_dedup.exact_dedup(docs).collect():
        assert (r.keep_id, r.group_size, r.kept) == (first[key[r.id]], size[key[r.id]], r.id == first[key[r.id]])
        assert bytes(r.digest).hex() == hashlib.sha256(key[r.id].encode()).hexdigest()
    assert {r.doc_id for r in op10_exact_dedup.keep_first(docs).collect()} == set(first.values())
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (5, "")], "doc_id long, text string")
    assert sorted(r.kept for r in op10_exact_dedup.exact_dedup(rows).collect()) == [False, False, False, True, True]


def test_perfect_hash_is_minimal():
    digests = np.random.default_rng(1).integers(0, 256, (5000, 32), dtype=np.uint8)
    sizes, bits, slot = op10_exact_dedup.build(digests)
    assert sorted(slot) == list(range(5000)) and (op10_exact_dedup.find(sizes, bits, digests) == slot).all()


def test_fingerprints(corpus):
    docs, texts = corpus
    rows = {r.id: r for r in op5_fingerprints.edited(docs).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, n = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        new = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (rows[i].fingerprint == rows[i].edited_fingerprint) == (rows[i].near_edited == 1.0)
    long = [i for i in ids if len(texts[i] or "") > 400 and i < 60]
    assert np.mean([rows[i].near_edited for i in long]) > 0.5 > np.mean([rows[i].near_next for i in long])


def test_fingerprints_add_up():
    prints = lambda t: op5_fingerprints.join_lanes(*op5_fingerprints.vectors(*textvec.text_views(pa.array([t]))))[0]
    one, two = prints("first line here"), prints("and a second line")
    both = prints("and a second line\nfirst line here")
    assert op5_fingerprints.add(one, two) == both == prints("first line here\nand a second line") and op5_fingerprints.add(both, two, -1) == one


def brute_components(texts, percent, n):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    name = {i: i for i in texts}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    name[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("percent", "n"), [(90, 3), (80, 5)])
def test_ngram_join(corpus, percent, n):
    docs, texts = corpus
    got = {r.id: (r.n_shingles, r.component_id) for r in op9_ngram_join.jaccard_components(docs, percent=percent, shingle=n).collect()}
    assert got == brute_components(texts, percent, n)


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m in ((50, 40), (9000, 3000), (4000, 4100)):
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 2 : n // 2 + m])
        (_, wa), (_, wb) = (op9_ngram_join.signatures(x, np.array([0, len(x)])) for x in (a, b))
        assert op9_ngram_join.least_apart(wa[0], wb[0]) <= len(np.setxor1d(a, b))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(50, 40), (40, 41)], "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 41: 40, 50: 40}


def test_substring_dedup(corpus):
    docs, texts = corpus
    out = {r.doc_id: r for r in op1_substring_dedup.substring_dedup(docs).collect()}
    assert set(out) == set(texts)
    seen: dict[bytes, int] = {}
    for i in sorted(texts):
        if texts[i] is None:
            assert out[i].text is None
            continue
        raw = texts[i].encode()
        buf = np.frombuffer(raw, np.uint8)
        begin, end, _, starts, _ = op1_substring_dedup._sentences(buf, np.array([0, len(raw)]))
        edge = [int(starts[b]) for b in begin] + [len(raw)]
        covered = set()
        for s in range(len(begin)):
            stop = next((e for e in range(s + 2, len(begin)) if end[e] - begin[s] >= op1_substring_dedup.MIN_WORDS), None)
            if stop is not None:
                run = b" ".join(raw[edge[s] : edge[stop + 1]].split())
                if run in seen:
                    covered.update(range(s, stop + 1))
                seen[run] = 1
        want = raw[: edge[0]] + b"".join(raw[edge[s] : edge[s + 1]] for s in range(len(begin)) if s not in covered)
        assert out[i].text == want.decode() and out[i].n_removed == len(covered)


def test_every_passage_of_over_50_words_lines_up():
    rng = random.Random(15)

    def some(n: int, letters: str, stop: float) -> list[str]:
        return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) + ("." if rng.random() < stop else "") for _ in range(n)]

    def hashes(words: list[str]) -> set[tuple[int, int]]:
        raw = " ".join(words).encode()
        return {(int(a), int(b)) for a, b in zip(*op1_substring_dedup._runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[3:])}

    for k in range(2000):
        stop = [0, 0.03, 0.08, 0.15][k % 4]
        passage = some(51, "abcdefgh", stop)
        one, two = (hashes(some(rng.randint(0, 40), a, stop) + passage + some(rng.randint(0, 40), a, stop)) for a in ("ijklmn", "opqrst"))
        assert one & two


def test_language_spans(spark):
    rng = random.Random(8)
    one = lambda n: " ".join(rng.choice(["the", "thing", "with", "other", "ship"]) + rng.choice(["", "s"]) for _ in range(n))
    two = lambda n: " ".join(rng.choice(["über", "nicht", "schön", "und", "keit"]) + rng.choice(["", "en"]) for _ in range(n))
    rows = [(i, one(40) if i % 2 else two(40), "en" if i % 2 else "de") for i in range(60)]
    model = op2_language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = spark.createDataFrame([(1, one(30) + " " + two(20) + " " + one(10)), (2, two(25)), (3, None), (4, "123 !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in op2_language.identify(new, model).collect()}
    assert [(s.lang, s.start) for s in got[1].spans][0] == ("en", 0) and [s.lang for s in got[1].spans] == ["en", "de", "en"]
    assert (got[1].lang_pred, got[2].lang_pred, got[2].score) == ("en", "de", 1.0)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5))


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(5)
    for n in (1, 2, 6):
        scores = rng.normal(0, 2, (n, 3)).astype(np.float32)
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023,E731
        got = op2_language.label(scores, np.array([0, n]), 1.5)
        assert abs(value(tuple(got)) - max(map(value, itertools.product(range(3), repeat=n)))) < 1e-4


def test_quality_and_toxicity_learn(spark):
    rng = random.Random(6)
    good = lambda: prose(rng, 60)
    bad = lambda: " | ".join(prose(rng, 1) + "$$$" for _ in range(60))
    rude = lambda: good() + " nasty" + rng.choice(["er", "est", "ish"]) + " " + good()
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        rows.append((i, bad() if kind == 1 else rude() if kind == 2 else good()))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for module, positive in ((op3_quality, (0, 2)), (op6_toxicity, (2,))):
        got = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, known)).collect()}
        right = [got[i] for i in range(0, 600, 2) if i % 3 in positive]
        wrong = [got[i] for i in range(0, 600, 2) if i % 3 not in positive]
        assert np.mean([a > b for a in right for b in wrong]) > 0.9


def test_quality_counts_every_unlabelled_row(spark):
    rng = random.Random(21)
    rows = [(i, prose(rng, 40) if i % 4 else " | ".join(prose(rng, 1) + "$$" for _ in range(rng.randint(5, 40)))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    known = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 500, 3)], "doc_id long, quality int")
    model = op3_quality.fit(docs, known, rows=200)  # all 125 positives, and 200 of the 333 unlabelled rows as the sample
    texts = [t.encode() for _, t in rows]
    x = op3_quality.features(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    good, rest = np.array([i % 3 == 0 and i % 4 != 0 for i, _ in rows]), np.array([i % 3 != 0 for i, _ in rows])
    assert np.allclose(model.mean, x[rest].mean(axis=0)) and np.allclose(model.scale, x[rest].std(axis=0) + 1e-6)
    table = op3_quality.feature_rows(docs.where("doc_id % 3 <> 0"), "doc_id", "text")
    value, slope = op3_quality.unlabelled_part(table, int(rest.sum()), model, model.weights)
    u, p = model.terms(x[rest]), model.terms(x[good])
    assert np.isclose(value, np.mean([np.log1p(np.exp(z)) for z in u @ model.weights]))
    assert np.allclose(slope, np.mean([row / (1 + np.exp(-(row @ model.weights))) for row in u], axis=0))
    # Corrected surrogates on a sample come close to the risk that a fit on all rows reaches.
    whole = op3_quality.minimise(p, u, model.prior)
    reached = op3_quality.risk(np.logaddexp(0, u @ whole).mean(), p, whole, model.prior)
    assert op3_quality.risk(value, p, model.weights, model.prior) < reached + 0.05


def test_quality_features_by_hand(spark):
    text = "The cat sat. The CAT sat sat!\n*** 12 x"
    words, size = text.split(), len(text)
    x = op3_quality.features(np.frombuffer(text.encode(), np.uint8), np.array([0, size]))[0]
    n = len(words)
    share = lambda test: sum(map(test, text)) / size
    assert np.allclose(x[:6], [np.log1p(size), np.log1p(n), share(str.isalpha), share(str.isdigit), share(lambda c: not c.isalnum() and not c.isspace()), share(str.isupper)])
    signs = len(op3_quality.SIGNS)
    assert np.allclose(x[6 : 6 + signs], [text.count(chr(s)) / n for s in op3_quality.SIGNS])
    lengths = [len(w) for w in words]
    solid = [sum(c.isalnum() for c in w) for w in words]
    hand = [1 / n, 0, 0, 0, 0, 0, 0, 0]
    hand[0] = sum(a == b for a, b in zip(words, words[1:])) / n
    hand[1] = len(set(words)) / n
    hand[2], hand[3] = np.mean(lengths), np.std(lengths)
    hand[4], hand[5] = sum(s == 0 for s in solid) / n, sum(a - s >= 3 for a, s in zip(lengths, solid)) / n
    hand[6], hand[7] = sum(a > 15 for a in lengths) / n, sum(w[0].isupper() for w in words) / n
    assert np.allclose(x[6 + signs :], [text.count("\n") / n, *hand, np.log1p(n / 2), np.log1p(n / 2)])


def test_toxicity_counts_every_labelled_row(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 30) + (f" odd{'abcdefghij'[i % 10]}" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    counted = {r.doc_id for r in known.where(F.pmod(F.xxhash64("doc_id", F.lit("calibrates")), F.lit(op6_toxicity.CALIBRATION_SHARE)) != 0).collect()}
    pairs, starts = (set(), set()), (set(), set())
    for i, text in rows:
        if i in counted:
            words = re.findall("[a-z]+", text)
            pairs[int(i % 4 != 0)].update(zip([None, *words], words))
            starts[int(i % 4 != 0)].update(words)
    text = docs.join(known, "doc_id").where(F.col("doc_id").isin(list(counted))).select("text", "toxic")
    words = op6_toxicity.counts(text).toPandas()
    assert [words["t"].sum(), words["o"].sum()] == [len(p) for p in pairs]
    assert [(words["t"] > 0).sum(), (words["o"] > 0).sum()] == [len(p) for p in starts]
    # A model of any size gives the same scores: what isn't broadcast is joined.
    whole, small = op6_toxicity.fit(docs, known, rows=10), op6_toxicity.fit(docs, known, rows=10, model_words=20)
    assert whole.tail is None and small.tail is not None and len(small.shared.value.words) < len(whole.shared.value.words)
    one, two = ({r.doc_id: r.score for r in op6_toxicity.score(docs, m).collect()} for m in (whole, small))
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-5 for i in one)


def test_kneser_ney_by_brute_force(spark):
    """Ratios of words and starts against the formula, written anew."""
    rng = random.Random(2)
    rows = [(i, prose(rng, 40) + (" uglyish ugly" if i % 3 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    counted = {r.doc_id for r in known.where(F.pmod(F.xxhash64("doc_id", F.lit("calibrates")), F.lit(op6_toxicity.CALIBRATION_SHARE)) != 0).collect()}
    k, starts = ({}, {}), ({}, {})
    for i, text in rows:
        if i in counted:
            words = re.findall("[a-z]+", text.lower())
            for v, w in zip([None, *words], words):
                k[int(i % 3 != 0)].setdefault(w, set()).add(v)
                starts[int(i % 3 != 0)].setdefault(w[:5], set()).add(w)
    k, starts = ([{w: len(v) for w, v in x.items()} for x in y] for y in (k, starts))

    def level(counts):
        out = []
        for x in counts:
            n = [sum(v == j for v in x.values()) for j in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
            d = [0.75] * 3 if y is None else [min(max(v, 0.05), j) for v, j in zip((1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5), (1, 2, 3))]
            take = lambda v, d=d: d[min(v, 3) - 1] if v else 0.0
            out.append((take, sum(x.values()), max(sum(map(take, x.values())) / sum(x.values()), 1e-3)))
        kinds = set(counts[0]) | set(counts[1])
        shared = 0.1 * (len(kinds) + 1) + sum(sum(map(o[0], x.values())) for o, x in zip(out, counts))
        common = lambda w: (sum(o[0](x.get(w, 0)) for o, x in zip(out, counts)) + 0.1) / shared
        return out, common

    of_starts, common_s = level(starts)
    of_words, common_w = level(k)

    def share(c, s):
        take, total, back = of_starts[c]
        n = starts[c].get(s, 0)
        return ((n - take(n)) / total + back * common_s(s)) / common_s(s)

    def probability(c, w):
        take, total, back = of_words[c]
        n = k[c].get(w, 0)
        return (n - take(n)) / total + back * common_w(w) * share(c, w[:5])

    model = op6_toxicity.fit(docs, known)
    for w in [*list(set(k[0]) | set(k[1]))[:50], "ugly", "uglyish", "uglyest", "unmet"]:
        n, a, b, _, _ = model.shared.value.of_texts(*textvec.text_views(pa.array([w])))
        assert n[0] == 1 and abs(a[0] - np.log(probability(0, w) / probability(1, w))) < 1e-4 and abs(b[0] - np.exp(a[0])) < 1e-6 * b[0]


PAGE = """<html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy this now, it is very cheap.</div><article><h1>Fish &amp; chips</h1><p>First   paragraph<br>goes on.<p>Second one &copy; here.</p><div class="share">Share this</div></article>
<aside>Related things to read</aside><section id="comments"><p>I liked it a lot, thank you.</p></section><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    assert op8_html.main_text(PAGE) == "Fish & chips\nFirst paragraph goes on.\nSecond one © here."
    assert op8_html.main_text(None) == op8_html.main_text("") == ""
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert {(r.page_id, r.n_chars) for r in op8_html.extract(df).collect()} == {(1, 56), (2, 0)}


def test_min_cut_is_least():
    import itertools

    rng = random.Random(9)
    for _ in range(30):
        n = rng.randint(1, 7)
        lead = [rng.uniform(-3, 3) for _ in range(n)]
        ties = [(i, j, rng.random() * 2) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda k: sum(-lead[i] for i in range(n) if k[i]) + sum(w for i, j, w in ties if k[i] != k[j])  # noqa: B023,E731
        assert abs(cost(op8_html.min_cut(lead, ties)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-4


def test_the_cut_mends_what_looks_mislead():
    """Without any sign, one-word paragraphs amid others are content by their ties alone."""
    words = "these are some words of a longer paragraph that goes on for a while and ends here."
    page = f"<div><div>{words}</div><div>Is.</div><div>{words}</div><div>So it goes.</div><div>{words}</div></div>"
    model = op8_html.Model(np.array([-4.0, 2.0, -4.0, 0.5, 1.0, -0.5, 4.0, 2.0, -8.0]), np.array([2.0, 0.5, 0.0]))
    found, keep, odds = op8_html.main_blocks(page, model)
    assert [x > 0 for x in odds] == [True, False, True, False, True] and keep == [True] * 5


def test_html_takes_linear_time():
    import time

    for bit in ('<a "', '<a href="', "<li>hello there<p>x", "<div>", "<div>word", "<", "<!--", "<script>", "</p>", "<div>a b<ul><li>c", "<p>" + "a few words <li><a>x</a>" * 3):
        took = []
        for size in (100_000, 400_000):
            start = time.process_time()
            op8_html.main_text(bit * (size // len(bit)))
            took.append(time.process_time() - start)
        assert took[1] < max(12 * took[0], 1.0) and took[1] < 6


def test_html_fit(spark):
    page = lambda k: f"<body><nav><ul>{'<li><a href=x>go there</a></li>' * 4}</ul></nav><div class=ad>Buy {k} of them now.</div><article><h1>Title {k}</h1>{'<p>A paragraph of some words.</p>' * 5}<p>No.</p></article><footer>us, {k}</footer></body>"
    pages = spark.createDataFrame([(k, "u", page(k)) for k in range(30)] + [(None, None, None)], "page_id long, url string, html string")
    model = op8_html.fit(pages)
    assert model.tie[op8_html.NEAR] > 1 and model.tie[op8_html.CROSSING] < 0.5
    want = lambda k: "\n".join([f"Title {k}", *["A paragraph of some words."] * 5, "No."])
    assert {r.page_id: r.text for r in op8_html.extract(pages, model=model).collect()} == {k: want(k) for k in range(30)} | {None: ""}
    bare = page(1).replace("nav>", "div>").replace("article>", "div>").replace("footer>", "div>").replace(" class=ad", "")
    assert op8_html.main_text(bare, model) == want(1)


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    docs, texts = corpus
    rng = random.Random(21)
    rude = {1000 + i: prose(rng, 40) + f" vile{'abc'[i % 3]} " + prose(rng, 20) + " filthy " + prose(rng, 9) for i in range(150)}
    more = {2000 + i: prose(rng, 60) for i in range(150)}
    both = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in (rude | more).items()], SCHEMA))
    labels = [(i, 1, int(i in rude)) for i in [*range(40), *rude, *more] if i < 1000 or i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()}
    assert len(kept & set(rude)) < 0.05 * len(rude) and len(set(more) - kept) < 0.03 * len(more)
    rows = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    left = {i: t for i, t in (texts | rude | more).items() if i in kept}
    key: dict[str, int] = {}
    for i in sorted(left):
        key.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i] or ""), i)
    near = brute_components({i: left[i] for i in key.values()}, 80, 5)
    assert set(rows.doc_id) == {i for i, (_, c) in near.items() if c == i}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "substring_dedup", "packing"]
