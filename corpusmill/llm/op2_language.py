"""Language of texts and of their parts (operator 2).

Every word's script, by ranges of code points, narrows the candidates to the languages that use it. The word itself,
its beginning and its end give each candidate a log-likelihood, from counts learned on labelled texts. Viterbi's
algorithm then labels the words of a text so that the sum of scores, less SWITCH for every change of language, is
greatest. Equal neighbours form spans. The text's language is that of most letters; the score is their share.

Most texts are in one language, and for those no search is needed: if no stretch of words gains more than SWITCH by any
mix of other languages, the path that stays is the best one. All other texts are searched together, word by word.

The fit takes about FIT_ROWS texts of each language, in one pass (a documented bound); where there are so many languages that
these are more than FIT_TEXTS, equally fewer of each, and never less than LEAST_ROWS. Every label can be predicted. Features
met in fewer than MIN_COUNT texts are left out, and the least frequent ones beyond MODEL_CELLS of features times languages.

Defined cases: a null text, or one without letters, is `und` with score 0; rows that repeat are labelled each; without
any labelled text all are `und`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .folds import fold
from .spaces import documents, small_batches

FIT_ROWS, LEAST_ROWS, FIT_TEXTS = 1_000, 20, 200_000
MIN_COUNT, MODEL_CELLS = 2, 40_000_000
SWITCH = 12.0
EDGE_BYTES = 4
UNKNOWN = "und"

#: First code points of the ranges of scripts, ascending, and the script from there on.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_FROM = np.array([c for c, _ in SCRIPTS])
_NAME = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Three feature hashes of each word (itself, its beginning, its end), its script, its length and the first word of each text."""
    low = tv.lower_latin(buf)
    starts, ends, first = tv.letter_words(low, offsets)
    prefix = tv.prefix_hash(low)
    head = tv.span_hash(prefix, starts, np.minimum(ends, starts + EDGE_BYTES))
    tail = tv.span_hash(prefix, np.maximum(starts, ends - EDGE_BYTES), ends)
    hashes = np.array([tv.span_hash(prefix, starts, ends), tv.mix_with(head, 21), tv.mix_with(tail, 22)]).reshape(3, -1)
    cp = low[starts].astype(np.int64)
    wide = np.flatnonzero(cp >= 0xC0)
    if len(wide):
        pos, code, _ = tv.code_points(low)
        cp[wide] = code[np.searchsorted(pos, starts[wide])]
    return hashes, _NAME[np.searchsorted(_FROM, cp, side="right") - 1], ends - starts, first


class Model:
    """Log-likelihoods of features by language, and which languages use which script."""

    def __init__(self, languages: list[str], keys: np.ndarray, counts: np.ndarray, texts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        self.map = tv.HashMap64()
        self.map.put(keys, np.arange(1, len(keys) + 1))
        rate = (counts + 0.05) / (texts + 1.0)
        table = np.log(rate / rate.mean(axis=1, keepdims=True)) if len(keys) else np.zeros((0, len(languages)))
        self.table = np.clip(np.concatenate([np.zeros((1, len(languages))), table]), -4, 4).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        self.allowed = np.where((share >= 0.01) | ~(share >= 0.01).any(axis=1, keepdims=True), 0.0, -50.0).astype(np.float32)

    def scores(self, hashes: np.ndarray, script: np.ndarray) -> np.ndarray:
        out = self.allowed[script]
        for h in hashes:
            out = out + self.table[np.maximum(self.map.get(h), 0)]
        return out


def label(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, by Viterbi over each text's words."""
    n, k = scores.shape
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    if not n:
        return np.zeros(0, np.int64)
    total = np.concatenate([np.zeros((1, k)), np.cumsum(scores, axis=0, dtype=np.float64)])
    main = np.argmax(total[first[1:]] - total[first[:-1]], axis=1)
    out = main[doc]
    if k == 1:
        return out
    rest = scores.copy()
    rest[np.arange(n), out] = -np.inf
    gain = rest.max(axis=1) - scores[np.arange(n), out]
    run = np.concatenate([[0.0], np.cumsum(gain, dtype=np.float64)])
    # Best sum of a stretch that ends at a word: the sum so far less its least value since the text began.
    far = (np.abs(run).max() + 1) * 4
    low = np.minimum.accumulate(run[:-1] - doc * far) + doc * far
    best = tv.maxima(run[1:] - low, first, -np.inf)
    mixed = np.flatnonzero(best > switch)
    if not len(mixed):
        return out
    mixed = mixed[np.argsort(-count[mixed], kind="stable")]
    start, size = first[mixed], count[mixed]
    value = scores[start].astype(np.float64)
    came = np.zeros((int(size[0]), len(mixed), k), np.int16) if size[0] * len(mixed) * k <= 20_000_000 else None
    if came is None:  # few texts at a time where they are very long
        half = max(1, len(mixed) // 2)
        if len(mixed) > 1:
            for part in (mixed[:half], mixed[half:]):
                sub = np.concatenate([[0], np.cumsum(count[part])])
                rows = tv.expand(first[part], count[part])
                out[rows] = label(scores[rows], sub, switch)
            return out
        came = np.zeros((int(size[0]), 1, k), np.int16)
    final = value.copy()
    for t in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -t, side="left"))
        v = value[:live]
        top = v.argmax(axis=1)
        jump = v[np.arange(live), top] - switch
        stay = v >= jump[:, None]
        came[t, :live] = np.where(stay, np.arange(k), top[:, None])
        value = np.where(stay, v, jump[:, None]) + scores[start[:live] + t]
        final[:live] = value
    at = final.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -t, side="left"))
        out[start[:live] + t] = at[:live]
        if t:
            at[:live] = came[t, np.arange(live), at[:live]]
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS) -> Model | None:
    """A model from about `rows` of the given texts for each language; None without any."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    given = known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each language
    languages = sorted(r[lang_col] for r in given)
    if not languages:
        return None
    # One pass takes of every language the texts whose hash is low enough, about `rows` of them, or all if there are no more.
    rows = min(rows, max(LEAST_ROWS, FIT_TEXTS // len(languages)))
    share = {r[lang_col]: min(1.0, rows / r["n"]) for r in given}
    chosen = docs.sparkSession.createDataFrame([(x, i, share[x]) for i, x in enumerate(languages)], T.StructType([T.StructField("of", T.StringType()), T.StructField("number", T.LongType()), T.StructField("share", T.DoubleType())]))
    texts = known.select(F.col(lang_col).cast("string").alias("of"), F.col(text_col).alias("text"), (F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)).alias("at"))
    text = texts.join(F.broadcast(chosen), "of").where(F.col("at") < F.col("share")).select("text", "number")  # a row for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tv.text_views(batch.column(0))
            lang = batch.column(1).to_numpy().astype(np.int64)
            for i, j in tv.chunks(off):
                hashes, script, _, first = words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                doc = np.repeat(np.arange(i, j), np.diff(first))
                (feature, doc), _ = tv.pair_counts(hashes.reshape(-1), np.tile(doc, 3), weights=[])
                (feature, spoken), (n,) = tv.pair_counts(feature, lang[doc], weights=[np.ones(len(feature))])
                at = np.repeat(lang[i:j], np.diff(first)) * len(SCRIPT_NAMES) + script
                seen = np.flatnonzero(np.bincount(at))
                texts = np.bincount(lang[i:j])
                told = np.flatnonzero(texts)
                kind = np.repeat(np.arange(3, dtype=np.int8), [len(feature), len(seen), len(told)])
                key = np.concatenate([feature.view(np.int64), seen % len(SCRIPT_NAMES), np.zeros(len(told), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(np.concatenate([spoken, seen // len(SCRIPT_NAMES), told])), pa.array(np.concatenate([n, np.bincount(at)[seen], texts[told]]))], ["kind", "key", "lang", "n"])

    found = small_batches(text).mapInArrow(run, "kind byte, key long, lang long, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    pdf = found.where((F.col("n") >= MIN_COUNT) | (F.col("kind") > 0)).toArrow().to_pandas()  # bounded by the sample
    feature = pdf[pdf["kind"] == 0]
    if feature["key"].nunique() * len(languages) > MODEL_CELLS:
        met = feature.groupby("key")["n"].sum().sort_index().sort_values(ascending=False, kind="stable")
        feature = feature[feature["key"].isin(met.index[: MODEL_CELLS // len(languages)])]
    keys, row = np.unique(feature["key"].to_numpy(np.int64).view(tv.U64), return_inverse=True)
    counts = np.zeros((len(keys), len(languages)))
    counts[row, feature["lang"]] = feature["n"]
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    marks = pdf[pdf["kind"] == 1]
    scripts[marks["key"], marks["lang"]] = marks["n"]
    texts = np.zeros(len(languages))
    of = pdf[pdf["kind"] == 2]
    texts[of["lang"]] = of["n"]
    return Model(languages, keys, counts, texts, scripts)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score and spans (first word, number of words, language) of every text."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MODEL_CELLS
    span = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.languages if m else [UNKNOWN], object)
        for batch in batches:
            buf, off = tv.text_views(batch.column(1))
            for i, j in tv.chunks(off, 4 * tv.CHUNK_BYTES * 16 // max(len(names), 16)):  # a score for each word and language
                hashes, script, size, first = words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                n = j - i
                doc = np.repeat(np.arange(n), np.diff(first))
                path = label(m.scores(hashes, script), first) if m else np.zeros(len(doc), np.int64)
                weight = np.bincount(doc * len(names) + path, weights=size, minlength=n * len(names)).reshape(n, len(names))
                letters = weight.sum(axis=1)
                best = weight.argmax(axis=1)
                some = (letters > 0) & (m is not None)
                score = np.where(some, weight[np.arange(n), best] / np.maximum(letters, 1), 0.0)
                new = np.ones(len(path), bool)
                new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
                head = np.flatnonzero(new)
                long = np.diff(np.append(head, len(path)))
                spans = pa.StructArray.from_arrays([pa.array(head - first[doc[head]]), pa.array(long), pa.array(names[path[head]], pa.string())], fields=list(span))
                edge = np.searchsorted(doc[head], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(np.where(some, names[best], UNKNOWN), pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(edge), spans)], [id_col, "lang_pred", "score", "spans"])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, spans array<struct<start: long, words: long, lang: string>>")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, fit(docs.where(fold("doc_id", 4) != 2)))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "spans")
