"""Quality by positive-unlabelled learning (operator 3).

Trusted positives are rows labelled good; everything else the model sees is unlabelled text. The risk of a score f is
    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]),
unbiased but for the floor at zero, which keeps it from going negative where f overfits (then only that part's
gradient is followed back). l is the logistic loss and f a linear function of the features and their squares. The
prior, the share of good text among the unlabelled, is estimated by the smallest ratio, over score regions, of
unlabelled to positive mass: where bad text is rare, that ratio is the prior.

Features are shares and lengths counted on the bytes of the whole text: kinds of characters, signs, words, lines,
sentences, repeats. Of the labelled rows at most FIT_ROWS positives are used (a documented bound). Of the unlabelled rows
all are: their means and spreads, the prior, and their part of the risk with its gradient are sums that Spark adds up over
a table of features. The weights come from surrogates of that risk: a bounded sample's unlabelled part, corrected by a
constant and a linear term so that value and gradient at the last weights are those of all rows. Each of ROUNDS surrogates
is minimised on the driver and costs one pass; of their minima the one with the least risk on all rows is kept. Where the
sample is the whole table the corrections are zero.

Defined cases: a null or empty text has all features zero and gets the score of that; rows that repeat are scored each;
without positives or unlabelled rows every score is the prior 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .folds import fold, sample
from .spaces import documents, drop, free_name, materialize, small_batches

FIT_ROWS = 6_000
THRESHOLD = 0.3
SIGNS = b"|%*#$&.,;:!?-_/@=<>\"'()[]{}~^+\\"
STEPS, RATE, DECAY = 800, 0.05, 1e-3
ROUNDS = 4


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    n = np.maximum(np.diff(offsets), 1).astype(float)
    starts, ends, first = tv.ascii_words(buf, offsets)
    words = np.diff(first)
    w = np.maximum(words, 1).astype(float)
    kind = tv.byte_classes(buf)
    share = lambda mask: tv.sums(mask, offsets) / n
    cols = [np.log1p(np.diff(offsets)), np.log1p(words), share(kind == tv.LETTER), share(kind == tv.NUMBER), share(kind == tv.OTHER), share((buf >= 65) & (buf <= 90))]
    counts = np.zeros((len(n), 256))
    owner = np.repeat(np.arange(len(n)), np.diff(offsets))
    if len(buf):
        counts = np.bincount(owner * 256 + buf, minlength=len(n) * 256).reshape(len(n), 256)
    for sign in SIGNS:
        cols.append(counts[:, sign] / w)
    cols.append(counts[:, 0x0A] / w)
    word = tv.span_hash(tv.prefix_hash(buf), starts, ends) if len(starts) else np.zeros(0, tv.U64)
    doc = np.repeat(np.arange(len(n)), words)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((word, doc))
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    size = ends - starts
    solid = (kind == tv.LETTER) | (kind == tv.NUMBER)
    total = np.concatenate([[0], np.cumsum(solid)])
    inner = total[ends] - total[starts] if len(starts) else np.zeros(0)
    per_word = lambda values: tv.sums(values, first) / w
    capital = (buf[starts] >= 65) & (buf[starts] <= 90) if len(starts) else np.zeros(0)
    cols += [per_word(same), tv.sums(fresh, first) / w, per_word(size), np.sqrt(np.maximum(per_word(size**2) - per_word(size) ** 2, 0)), per_word(inner == 0), per_word(size - inner >= 3), per_word(size > 15), per_word(capital)]
    cols.append(np.log1p(w / np.maximum(counts[:, 0x2E] + counts[:, 0x21] + counts[:, 0x3F], 1)))
    cols.append(np.log1p(w / (counts[:, 0x0A] + 1)))
    return np.column_stack(cols)


class Model:
    def __init__(self, mean=None, scale=None, weights=None, prior=0.5):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([z, z * z - 1, np.ones(len(z))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.terms(x) @ self.weights, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def minimise(p: np.ndarray, u: np.ndarray, prior: float, floor: bool = True, shift: float = 0.0, slope: np.ndarray | float = 0.0) -> np.ndarray:
    """Weights w that minimise the non-negative risk on the terms of positives p and unlabelled u, by Adam on all their rows.

    shift + slope @ w is added to the unlabelled part.
    """
    weights, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    slope = slope + np.zeros(p.shape[1])
    for t in range(1, STEPS + 1):
        fp, fu = _sigmoid(p @ weights), _sigmoid(u @ weights)
        rest = np.logaddexp(0, u @ weights).mean() + shift + slope @ weights - prior * np.logaddexp(0, p @ weights).mean()
        good = prior * (p.T @ (fp - 1)) / len(p)
        bad = (u.T @ fu) / len(u) + slope - prior * (p.T @ fp) / len(p)
        g = (good + bad if rest >= 0 or not floor else -bad) + DECAY * weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights = weights - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return weights


def prior_cuts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores above which to compare masses, and the share of positives above each."""
    cuts = np.quantile(p, np.linspace(0.02, 0.8, 40))
    return cuts, (p[:, None] >= cuts).mean(axis=0)


def estimate_prior(own: np.ndarray, positives: int, other: np.ndarray, unlabelled: int) -> float:
    """Share of positives among the unlabelled: the least ratio of unlabelled to positive rows above a score, with an allowance for chance."""
    slack = np.sqrt(other * (1 - other) / unlabelled) + own * np.sqrt((1 - own) / (own * positives))
    return float(np.clip(((other + slack) / own).min(), 0.02, 0.98))


def feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and features x of every row of docs with an id."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tv.text_views(batch.column(1))
            for i, j in tv.chunks(off):
                x = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                edges = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(edges, pa.array(x.reshape(-1)))], [id_col, "x"])

    return small_batches(docs.select(id_col, text_col).where(F.col(id_col).isNotNull())).mapInArrow(run, f"`{id_col}` {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of of(x) over all batches x of features; a task sends on one vector. None where there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    found = rows.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()  # as many rows as a vector has numbers
    return np.array([r.value for r in sorted(found, key=lambda r: r.place)]) if found else None


def unlabelled_part(rows: DataFrame, n: int, model: Model, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean of l(-f) over all n rows, and its gradient."""

    def part(x: np.ndarray) -> np.ndarray:
        t = model.terms(x)
        z = t @ w
        return np.concatenate([[np.logaddexp(0, z).sum()], t.T @ _sigmoid(z)])

    found = sums(rows, part) / n
    return float(found[0]), found[1:]


def risk(value: float, p: np.ndarray, w: np.ndarray, prior: float, floor: bool = True) -> float:
    """The risk of weights w, value being its unlabelled mean, with the decay that minimise() adds."""
    rest = value - prior * np.logaddexp(0, p @ w).mean()
    return float(prior * np.logaddexp(0, -(p @ w)).mean() + (max(rest, 0.0) if floor else rest) + DECAY * (w @ w) / 2)


def minimise_all(rows: DataFrame, n: int, model: Model, p: np.ndarray, u: np.ndarray, prior: float, floor: bool = True) -> np.ndarray:
    """Weights for the risk on positives p and all n rows, by surrogates on their sample u."""
    weights = best = minimise(p, u, prior, floor)
    least = np.inf
    for turn in range(ROUNDS + 1):
        value, slope = unlabelled_part(rows, n, model, weights)
        here = risk(value, p, weights, prior, floor)
        if here < least:
            best, least = weights, here
        if turn == ROUNDS or len(u) == n:
            break
        z = u @ weights
        slope = slope - (u.T @ _sigmoid(z)) / len(u)
        weights = minimise(p, u, prior, floor, value - np.logaddexp(0, z).mean() - slope @ weights, slope)
    return best


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, unlabelled: DataFrame | None = None) -> Model:
    """A model from at most `rows` rows that labels marks 1 and all rows with an id in unlabelled (by default those without a label)."""
    known = labels.where(F.col(id_col).isNotNull())
    good = sample(known.where(F.col(label_col) == 1).select(id_col).distinct(), id_col, rows)
    if unlabelled is None:
        unlabelled = docs.select(id_col).where(F.col(id_col).isNotNull()).join(known.select(id_col), id_col, "left_anti")
    table = materialize(feature_rows(docs, id_col, text_col), "quality-features")
    rest = table.join(unlabelled.select(id_col).distinct(), id_col, "left_semi")
    own = table.join(F.broadcast(good), id_col).select("x")  # at most `rows` ids
    rest = materialize(rest, "quality-unlabelled")
    few = rest.join(F.broadcast(sample(rest.select(id_col).distinct(), id_col, rows)), id_col, "left_semi").select("x")

    def sorted_rows(found: pa.Table) -> np.ndarray:
        x = _matrix(found["x"].combine_chunks()) if found.num_rows else np.zeros((0, 0))
        return x[np.lexsort(x.T)] if len(x) else x  # the same order however the rows arrived

    x_own, x_few = sorted_rows(own.toArrow()), sorted_rows(few.toArrow())  # at most `rows` ids each
    model = Model()
    if len(x_own) and len(x_few):
        found = sums(rest, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
        n, d = int(found[0]), x_own.shape[1]
        mean = found[1 : d + 1] / n
        model = Model(mean, np.sqrt(np.maximum(found[d + 1 :] / n - mean * mean, 0)) + 1e-6)
        p, u = model.terms(x_own), model.terms(x_few)
        plain = minimise_all(rest, n, model, p, u, 0.5, floor=False)
        cuts, share = prior_cuts(p @ plain)
        above = sums(rest, lambda x: ((model.terms(x) @ plain)[:, None] >= cuts).sum(axis=0).astype(float))
        model.prior = estimate_prior(share, len(p), above / n, n)
        model.weights = minimise_all(rest, n, model, p, u, model.prior)
    drop(table, rest)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of docs and the score, last, with _ in front of its name where docs has such a column."""
    score_col = free_name(docs.columns, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tv.text_views(batch.column(at))
            out = [shared.value.score(features(buf[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in tv.chunks(off)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*batch.schema.names, score_col])

    return small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
