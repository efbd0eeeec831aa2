"""Toxicity by class-conditional Kneser-Ney models (operator 6).

A toxic and an ordinary model of words score every text. Both count as Kneser and Ney do: a word by the different words
before it, a word's start by the different words that begin so; copies and repeated passages therefore weigh as one.
The discounts are the modified ones, estimated for each class and level from its counts of counts. What they take goes
to counts that both classes share (a class gives a word no more of them than the discount takes), split over the starts
of words by class:

    P_c(w) = max(k_c(w) - D, 0) / K_c + back_c P(w) P_c(start of w) / P(start of w)
    P_c(s) = max(t_c(s) - D, 0) / T_c + back_c P(s)

So an expression met once gives neither class much of its own, and one that is new to both is judged by its start.
A text's two log-likelihoods are normalised by its number of words, in two ways: the mean over its words of the log of
P_toxic / P_ordinary, and the log of the mean of that ratio, to which a few very toxic words in a long text still count.
A logistic curve, fitted on labelled rows that the counts have not seen, turns both into the score; it is shifted so
that THRESHOLD is where the F1 of those rows is greatest.

Counts come from all labelled rows but those that calibrate, gathered by Spark. The curve alone is fitted on at most
FIT_ROWS rows of each class. Of the words the most frequent ones, at most MODEL_WORDS, are broadcast with their ratios;
all others, each rare, meet the texts that have them in a join. Ratios of starts lie in an array of fixed size.

Defined cases: a null or empty text has no words and is scored by the curve at zero; rows that repeat are scored each;
labels other than 0 and 1, or of a null id, are left out; with labels of one class only, or none, every score is the
share of toxic labels; where the table has a column named as the score is, the score's name gets _ in front; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .folds import fit_logistic, fold, sample
from .spaces import documents, free_name, materialize, small_batches

FIT_ROWS = 6_000
BROADCAST_LABELS = 1_000_000  # more labels meet the texts in a join that Spark picks
MODEL_WORDS = 2_000_000
START_BYTES, START_BITS = 5, 22
WORD_BITS = 64 - START_BITS
UNSEEN = 0.1  # shared count of a word that no class has
THRESHOLD = 0.7
CALIBRATION_SHARE = 4  # one labelled row in so many calibrates instead of being counted
CLASSES = ("t", "o")  # toxic, ordinary


def word_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of each word, whose upper START_BITS stand for its start, and the index of the first word of each text."""
    low = tv.lower_latin(buf)
    starts, ends, first = tv.letter_words(low, offsets)
    prefix = tv.prefix_hash(low)
    head = tv.mix_with(tv.span_hash(prefix, starts, np.minimum(ends, starts + START_BYTES)), 7)
    return (head >> tv.U64(WORD_BITS)) << tv.U64(WORD_BITS) | tv.span_hash(prefix, starts, ends) >> tv.U64(START_BITS), first


def _before(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """32 bits of the word before each one; at a text's start a mark of its own."""
    v = np.empty(len(words), np.int32)
    v[1:] = (words[:-1] & tv.U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    v[first[:-1][first[:-1] < len(words)]] = 1
    return v


def counts(text: DataFrame) -> DataFrame:
    """w, t and o: every word with the number of different words before it in toxic and in ordinary texts (columns text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tv.text_views(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in tv.chunks(off):
                w, first = word_keys(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                doc = np.repeat(toxic[i:j], np.diff(first))
                (w, v), (t, o) = tv.pair_counts(w, _before(w, first), weights=[doc, ~doc])
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(v), pa.array(((t > 0) + 2 * (o > 0)).astype(np.int8))], ["w", "v", "seen"])

    pairs = small_batches(text.select("text", "toxic")).mapInArrow(run, "w long, v int, seen byte").groupBy("w", "v").agg(F.bit_or("seen").alias("seen"))
    return pairs.groupBy("w").agg(*(F.count_if(F.col("seen").bitwiseAND(bit) > 0).alias(c) for c, bit in zip(CLASSES, (1, 2))))


class Level:
    """Discounts, sums and shares of one level of counts, from its counts of counts; expressions of its probabilities."""

    def __init__(self, table: DataFrame):
        of = [f(c) for c in CLASSES for f in (lambda c: F.sum(c), *((lambda c, k=k: F.count_if(F.col(c) == k)) for k in (1, 2, 3, 4)), lambda c: F.count_if(F.col(c) > 2))]
        found = np.array([x or 0 for x in table.agg(F.count(F.lit(1)), *of).first()], float)
        self.discounts, self.total, self.back, self.shared = [], [], [], UNSEEN * (found[0] + 1)
        for total, n1, n2, n3, n4, more in found[1:].reshape(2, 6):
            d = self._discounts(n1, n2, n3, n4)
            taken = d[0] * n1 + d[1] * n2 + d[2] * more
            self.discounts.append(d)
            self.total.append(max(total, 1.0))
            self.back.append(max(taken / max(total, 1.0), 1e-3))
            self.shared += taken

    @staticmethod
    def _discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
        """The modified discounts of counts of one, two, and three or more."""
        if not (n1 and n2):
            return [0.75, 0.75, 0.75]
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return [min(max(d, 0.05), k) for d, k in zip(raw, (1.0, 2.0, 3.0))]

    def taken(self, c: int) -> F.Column:
        k, d = F.col(CLASSES[c]), self.discounts[c]
        return F.when(k > 2, F.lit(d[2])).when(k == 2, F.lit(d[1])).when(k == 1, F.lit(d[0])).otherwise(F.lit(0.0))

    def common(self) -> F.Column:
        """The probability by the counts that the classes share."""
        return (self.taken(0) + self.taken(1) + UNSEEN) / self.shared

    def own(self, c: int) -> F.Column:
        return (F.col(CLASSES[c]) - self.taken(c)) / self.total[c]


class Ratios:
    """Log ratios of words and of starts; small to send, looked up by a hash map and an array that every worker makes once."""

    def __init__(self, words: np.ndarray, ratios: np.ndarray, starts: np.ndarray, bases: np.ndarray, unmet: float, tail: bool):
        self.words, self.ratios, self.starts, self.bases, self.unmet, self.tail = words, ratios, starts, bases, np.float32(unmet), tail

    def _ready(self) -> None:
        if not hasattr(self, "found"):
            self.found = tv.HashMap64()
            self.found.put(self.words, np.arange(len(self.words)))
            self.base = np.full(1 << START_BITS, self.unmet)
            self.base[self.starts] = self.bases

    def of_texts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text: its words, the sum of their log ratios, the sum of their ratios; and the words that are looked up elsewhere, with the text of each."""
        self._ready()
        w, first = word_keys(buf, offsets)
        n = np.diff(first)
        kinds, back = np.unique(w, return_inverse=True)
        at = self.found.get(kinds)
        r = self.base[(kinds >> tv.U64(WORD_BITS)).astype(np.int64)].astype(float)
        r[at >= 0] = self.ratios[at[at >= 0]]
        lost = np.flatnonzero((at < 0)[back]) if self.tail else np.zeros(0, np.int64)
        r = r[back]
        return n, tv.sums(r, first), tv.sums(np.exp(r), first), w[lost], np.repeat(np.arange(len(n)), n)[lost]


class Model:
    """The ratios as Spark broadcasts them, those of rare words as a table, and the curve; without ratios the prior alone."""

    def __init__(self, prior: float, shared: Broadcast | None = None, tail: DataFrame | None = None):
        self.prior, self.shared, self.tail, self.curve = prior, shared, tail, None


def likelihoods(text: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """All columns of text and three more, whose names come second: words, and sums over them of the log ratio and of the ratio."""
    held = model.shared
    row = free_name(text.columns, "row")
    names = [free_name([*text.columns, row], x) for x in ("words", "log_ratios", "ratios")]
    lost_name = free_name([*text.columns, row, *names], "lost")
    kinds = [T.LongType(), T.DoubleType(), T.DoubleType()]
    if model.tail is not None:
        text = materialize(text.withColumn(row, F.monotonically_increasing_id()), "toxicity-rows")
    at, more = text.columns.index(text_col), [lost_name] if model.tail is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tv.text_views(batch.column(at))
            for i, j in tv.chunks(off):
                n, a, b, lost, owner = held.value.of_texts(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                cols = [*(c.slice(i, j - i) for c in batch.columns), pa.array(n), pa.array(a), pa.array(b)]
                if more:
                    edges = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(lost.view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, *names, *more])

    schema = [*text.schema.fields, *(T.StructField(x, k) for x, k in zip(names, kinds)), *(T.StructField(x, T.ArrayType(T.LongType())) for x in more)]
    out = small_batches(text).mapInArrow(run, T.StructType(schema))
    if model.tail is None:
        return out, names
    out = materialize(out, "toxicity-likelihoods")
    rare = out.select(F.col(row).alias("row"), F.explode(lost_name).alias("w")).groupBy("row", "w").agg(F.count(F.lit(1)).alias("n")).join(model.tail, "w")
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * (F.col("r") - F.col("base"))).alias("more_a"), F.sum(F.col("n") * (F.exp("r") - F.exp("base"))).alias("more_b"))
    out = out.join(rare.withColumnRenamed("row", row), row, "left")
    for x, add in zip(names[1:], ("more_a", "more_b")):
        out = out.withColumn(x, F.col(x) + F.coalesce(F.col(add), F.lit(0.0)))
    return out.drop(row, lost_name, "more_a", "more_b"), names


def _features(names: list[str]) -> tuple[F.Column, F.Column]:
    """The length-normalised log-likelihoods' difference, and the log of the mean ratio; both 0 without words."""
    n, a, b = (F.col(x) for x in names)
    return F.when(n > 0, a / n).otherwise(0.0), F.when(n > 0, F.log(b / n)).otherwise(0.0)


def _best_cut(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The cut of greatest F1, amid the gap between the scores that it parts."""
    order = np.argsort(-z, kind="stable")
    z, hit, w = z[order], y[order] > 0, w[order]
    right, taken = np.cumsum(w * hit), np.cumsum(w)
    f1 = 2 * right / (taken + right[-1])
    f1[:-1][z[1:] == z[:-1]] = -1  # no cut parts ties
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k]) - 1.0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, model_words: int = MODEL_WORDS) -> Model:
    """A model from all labelled documents, its curve from at most `rows` of each class; labels holds id_col and label_col (0 or 1)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(id_col, F.col(label_col).alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = shares.get(1, 0) / max(sum(shares.values()), 1)
    if min(shares.get(0, 0), shares.get(1, 0)) == 0:
        return Model(prior)
    known = known.withColumn("calibrates", F.pmod(F.xxhash64(F.col(id_col), F.lit("calibrates")), F.lit(CALIBRATION_SHARE)) == 0)
    chosen = known.where(~F.col("calibrates"))
    for c in (1, 0):
        chosen = chosen.unionByName(sample(known.where(F.col("calibrates") & (F.col("toxic") == c)), id_col, rows))
    if sum(shares.values()) <= BROADCAST_LABELS:
        chosen = F.broadcast(chosen)
    text = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(chosen, id_col)
    text = materialize(text.select("text", "toxic", "calibrates"), "toxicity-fit")
    words = materialize(counts(text.where(~F.col("calibrates"))).withColumn("s", F.shiftrightunsigned("w", WORD_BITS)), "toxicity-words")
    starts = materialize(words.groupBy("s").agg(*(F.count_if(F.col(c) > 0).alias(c) for c in CLASSES)), "toxicity-starts")
    of_words, of_starts = Level(words), Level(starts)
    share = [(of_starts.own(c) + of_starts.back[c] * of_starts.common()) / of_starts.common() for c in (0, 1)]
    starts = starts.select("s", *(x.alias(f"share_{c}") for c, x in zip(CLASSES, share)))
    base = F.log(of_words.back[0] * F.col("share_t") / (of_words.back[1] * F.col("share_o")))
    each = [of_words.own(c) + of_words.back[c] * of_words.common() * F.col(f"share_{CLASSES[c]}") for c in (0, 1)]
    scored = words.join(starts, "s").select("w", (F.col("t") + F.col("o")).alias("k"), F.log(each[0] / each[1]).alias("r"), base.alias("base"))
    unmet = np.log(of_words.back[0] * of_starts.back[0] / (of_words.back[1] * of_starts.back[1]))
    by_start = starts.select(F.col("s").cast("int").alias("s"), base.cast("float").alias("base")).toArrow()  # at most 2 ** START_BITS rows
    many, least = 0, 1 << 40
    for r in words.groupBy(F.least(F.col("t") + F.col("o"), F.lit(10_000)).alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).collect():
        if many + r["n"] > model_words:
            break
        many, least = many + r["n"], r["k"]
    else:
        least = 0  # all of them
    top = scored.where(F.col("k") >= least).select("w", F.col("r").cast("float").alias("r")).toArrow()  # at most model_words rows
    tail = materialize(scored.where(F.col("k") < least).select("w", "r", "base"), "toxicity-tail") if least else None
    ratios = Ratios(top["w"].to_numpy().view(tv.U64), top["r"].to_numpy(), by_start["s"].to_numpy(), by_start["base"].to_numpy(), unmet, tail is not None)
    del top, by_start
    model = Model(prior, docs.sparkSession.sparkContext.broadcast(ratios), tail)
    seen, names = likelihoods(text.where("calibrates"), model)
    seen = seen.select("toxic", *(x.alias(f"x{k}") for k, x in enumerate(_features(names)))).toPandas()
    y = seen["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        x = seen[["x0", "x1"]].to_numpy(float)
        curve = fit_logistic(x, y, weight)
        curve[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut(x @ curve[:-1] + curve[-1], y, weight)
        model.curve = curve
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs and the score, last."""
    name = free_name(docs.columns, score_col)
    if model.curve is None:
        return docs.withColumn(name, F.lit(float(model.prior)))
    out, names = likelihoods(docs, model, text_col)
    x0, x1 = _features(names)
    z = x0 * float(model.curve[0]) + x1 * float(model.curve[1]) + float(model.curve[2])
    return out.withColumn(name, 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).select(*docs.columns, name)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 3) != 1)
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
