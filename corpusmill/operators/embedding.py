"""Feature-hashing embeddings: a text becomes its vector in the task that reads it, so nothing is shuffled.

Weights are the integers 20, 12 and 7 (words, pairs of neighbours, character grams), so sums are exact whatever the order of
addition. A task remembers for every run of letters, digits and _ its tokens and what one use of it adds, words and all grams
together, and hashes the grams of new tokens on their bytes, many tokens at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import columns as C

WORD, PAIR, GRAM = 20, 12, 7
WORDS, PIECES = re.compile(r"[a-z0-9_]+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
BETWEEN = "[^A-Za-z0-9_\u0130\u212a]+"  # no token goes beyond a run of the others; the last two are the only others with ASCII letters in lower case
REMEMBERED = 200_000  # runs or tokens that a task remembers at most
LONG_TOKEN = 256
CELLS, FEW = 2_000_000, 100  # sums held at once in a task, and texts summed at once


def tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos and token, in the order of code_tokens."""
    return texts.select(key, F.posexplode(C.code_tokens(F.col(text))).alias("pos", "token"))


def gram_table(vocabulary: DataFrame) -> DataFrame:
    """token, gram and times of each distinct token of three characters or more."""
    return vocabulary.where(F.length("token") >= 3).select("token", F.explode(C.char_ngrams(F.col("token"))).alias("gram")).groupBy("token", "gram").agg(F.count(F.lit(1)).alias("times"))


def words_and_pieces(text: str) -> tuple[list[str], list[str]]:
    """The words of a text with the parts of those joined by _, and its pieces by case."""
    out = []
    for word in WORDS.findall(text.lower()):
        out.append(word)
        if "_" in word:
            out += [p for p in word.split("_") if p and p != word]
    return out, [p.lower() for p in PIECES.findall(text) if len(p) > 1]


def text_tokens(text: str) -> list[str]:
    """What code_tokens() gives, of one text."""
    words, pieces = words_and_pieces(text)
    return words + pieces


def _fold(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FNV-1a of spans of bytes, all at once, going on from a state for each."""
    out = state.astype(np.uint64)
    order = np.argsort(-sizes, kind="stable")
    falling = -sizes[order]
    prime, mask = np.uint64(C.FNV_PRIME), np.uint64(C.MASK_32)
    for k in range(min(int(sizes.max(initial=0)), LONG_TOKEN)):
        at = order[: np.searchsorted(falling, -k, side="left")]
        out[at] = ((out[at] ^ data[starts[at] + k]) * prime) & mask
    for i in order[: np.searchsorted(falling, -LONG_TOKEN, side="left")]:  # few, each as long as a text
        h = int(out[i])
        for byte in data[starts[i] + LONG_TOKEN : starts[i] + sizes[i]].tolist():
            h = ((h ^ byte) * C.FNV_PRIME) & C.MASK_32
        out[i] = h
    return out


def _start(prefix: str) -> int:
    h = C.FNV_START
    for byte in prefix.encode():
        h = ((h ^ byte) * C.FNV_PRIME) & C.MASK_32
    return h


def _spans(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _expand(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for sizes[i] places, one run after the other."""
    return np.repeat(first - _spans(sizes), sizes) + np.arange(int(sizes.sum()))


class Index(dict):
    """Numbers of tokens or runs, given when they are first asked for."""

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


class Lists:
    """Lists of numbers by number, one after the other."""

    def __init__(self):
        self.flat, self.edge = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.edge = np.concatenate([self.flat, flat]), np.concatenate([self.edge, self.edge[-1] + np.cumsum(sizes)])

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these, one after the other, and their sizes."""
        sizes = self.edge[which + 1] - self.edge[which]
        return self.flat[_expand(self.edge[which], sizes)], sizes


class Vocabulary:
    """What one use of each run adds to the buckets, its tokens, and where the hash of a pair goes on from."""

    def __init__(self, dim: int):
        self.dim, self.index, self.known = dim, Index(), 0
        self.runs, self.known_runs = Index(), 0
        self.words, self.pieces, self.kinds, self.uses = Lists(), Lists(), Lists(), np.zeros(0, np.int64)  # tokens of runs, and how often each
        self.data, self.first, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.state = np.zeros(0, np.uint64)
        self.bucket, self.value, self.edge = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _hashed(self, h: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
        return (h % np.uint64(self.dim)).astype(np.int64), np.where(h & np.uint64(65536), -weight, weight)

    def learn(self) -> None:
        """Hashes the tokens that were numbered since the last time."""
        new = list(islice(self.index, self.known, None))
        if not new:
            return
        size = np.fromiter(map(len, new), np.int64, len(new))
        data = np.frombuffer("".join(new).encode("ascii"), np.uint8)
        first = _spans(size)
        bucket, value = self._hashed(_fold(np.full(len(new), _start("w:"), np.uint64), data, first, size), WORD)
        owner = [np.arange(len(new))]
        buckets, values = [bucket], [value]
        # Grams of ^token$, of all tokens of three characters or more.
        some = np.flatnonzero(size >= 3)
        framed, at = np.zeros(int(size[some].sum()) + 2 * len(some), np.uint8), _spans(size[some] + 2)
        framed[at], framed[at + size[some] + 1] = ord("^"), ord("$")
        framed[_expand(at + 1, size[some])] = data[_expand(first[some], size[some])]
        of = np.repeat(np.arange(len(some)), size[some] + 2)
        end = (at + size[some] + 2)[of]
        h = np.full(len(framed), _start("c:"), np.uint64)
        here = np.arange(len(framed))
        for k in range(5):
            real = here + k < end
            h[real] = ((h[real] ^ framed[here[real] + k]) * np.uint64(C.FNV_PRIME)) & np.uint64(C.MASK_32)
            if k >= 2:
                bucket, value = self._hashed(h[real], GRAM)
                owner.append(some[of[real]])
                buckets.append(bucket)
                values.append(value)
        key = np.concatenate(owner) * self.dim + np.concatenate(buckets)
        kinds, back = np.unique(key, return_inverse=True)
        total = np.bincount(back, np.concatenate(values), len(kinds)).astype(np.int64)
        many = np.bincount(kinds // self.dim, minlength=len(new))
        self.bucket, self.value = np.concatenate([self.bucket, (kinds % self.dim).astype(np.int32)]), np.concatenate([self.value, total])
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(many)])
        state = _fold(np.full(len(new), _start("b:"), np.uint64), data, first, size)
        self.state = np.concatenate([self.state, ((state ^ np.uint64(ord("_"))) * np.uint64(C.FNV_PRIME)) & np.uint64(C.MASK_32)])
        self.first, self.size, self.data = np.concatenate([self.first, first + len(self.data)]), np.concatenate([self.size, size]), np.concatenate([self.data, data])
        self.known = len(self.index)

    def learn_runs(self) -> None:
        """Takes the runs that were numbered since the last time apart into tokens."""
        new = list(islice(self.runs, self.known_runs, None))
        if not new:
            return
        told = [run.isascii() and run.isalpha() and (run[1:].islower() or run.isupper()) for run in new]  # its only word is its only piece
        plain, long = np.array(told), np.fromiter(map(len, new), np.int64, len(new)) > 1
        number, one = self.index.setdefault, np.zeros(len(new), np.int64)
        one[plain] = [number(run.lower(), len(self.index)) for run in compress(new, told)]
        odd = [[[number(t, len(self.index)) for t in some] for some in words_and_pieces(run)] for run in compress(new, ~plain)]
        uses = np.where(plain & long, 2, 1)
        for held, many, some in ((self.words, 1, [w for w, _ in odd]), (self.pieces, long[plain], [p for _, p in odd]), (self.kinds, 1, [w + p for w, p in odd])):
            sizes = np.empty(len(new), np.int64)
            sizes[plain], sizes[~plain] = many, [len(x) for x in some]
            flat = np.repeat(one, sizes)
            flat[_expand(_spans(sizes)[~plain], sizes[~plain])] = list(chain.from_iterable(some))
            held.add(flat, sizes)
        self.uses = np.concatenate([self.uses, np.repeat(uses, sizes)])
        self.known_runs = len(self.runs)
        self.learn()

    def read(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """The runs of all texts and the text of each; then text, run and times of each run of a text."""
        found = pc.split_pattern_regex(pa.array(texts, pa.string()), BETWEEN)
        coded = found.flatten().dictionary_encode()
        number = self.runs.__getitem__
        numbers = np.array([number(run) if run else -1 for run in coded.dictionary.to_numpy(zero_copy_only=False)], np.int64)
        self.learn_runs()
        runs, doc = numbers[coded.indices.to_numpy()], np.repeat(np.arange(len(texts)), found.value_lengths().to_numpy())
        real = runs >= 0  # a text may begin and end with what is between runs
        runs, doc, known = runs[real], doc[real], max(self.known_runs, 1)
        key, times = np.unique(doc * known + runs, return_counts=True)
        return runs, doc, key // known, key % known, times

    def sums(self, texts: list[str]) -> np.ndarray:
        """The signed sums of all features' weights: a row for each text, a column for each bucket."""
        return self.sums_of(len(texts), *self.read(texts))

    def sums_of(self, texts: int, runs: np.ndarray, doc: np.ndarray, of: np.ndarray, run: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The same from what read() gave, a few texts at once, so that what is summed stays in a core's cache."""
        out = np.zeros((texts, self.dim), np.int64)
        for low in range(0, texts, FEW):
            high = min(low + FEW, texts)
            a, b = np.searchsorted(of, low), np.searchsorted(of, high)
            c, d = np.searchsorted(doc, low), np.searchsorted(doc, high)
            out[low:high] = self._added(high - low, runs[c:d], doc[c:d] - low, of[a:b] - low, run[a:b], times[a:b])
        return out

    def _added(self, texts: int, runs: np.ndarray, doc: np.ndarray, of: np.ndarray, run: np.ndarray, times: np.ndarray) -> np.ndarray:
        size = self.kinds.edge[run + 1] - self.kinds.edge[run]
        at = _expand(self.kinds.edge[run], size)
        token, times = self.kinds.flat[at], np.repeat(times, size) * self.uses[at]
        many = self.edge[token + 1] - self.edge[token]
        at = _expand(self.edge[token], many)
        cell, value = np.repeat(np.repeat(of * self.dim, size), many), np.repeat(times.astype(float), many)
        cell += self.bucket[at]
        value *= self.value[at]
        out = np.bincount(cell, value, texts * self.dim)
        # Neighbours: of each text first the tokens of its words, then its pieces.
        (words, n), (pieces, m) = self.words.of(runs), self.pieces.of(runs)
        n, m = (np.bincount(doc, x, texts).astype(np.int64) for x in (n, m))
        first, ids = _spans(n + m), np.empty(len(words) + len(pieces), np.int64)
        ids[_expand(first, n)], ids[_expand(first + n, m)] = words, pieces
        doc, known = np.repeat(np.arange(texts), n + m), max(self.known, 1)
        both = np.flatnonzero(doc[1:] == doc[:-1])
        pair, back = np.unique(ids[both] * known + ids[both + 1], return_inverse=True)
        one, two = pair // known, pair % known
        bucket, signed = self._hashed(_fold(self.state[one], self.data, self.first[two], self.size[two]), PAIR)
        out += np.bincount(doc[both] * self.dim + bucket[back], signed[back], texts * self.dim)
        return out.astype(np.int64).reshape(texts, self.dim)


def embedded(texts: DataFrame, key: str, text: str, fields: list[T.StructField], vocabulary: Callable[[], Vocabulary], told: Callable[[Vocabulary, list[str]], list[pa.Array]], dim: int) -> DataFrame:
    """key and what told() makes of some texts at once, in the task that reads the texts."""
    rows = max(1, min(1000, CELLS // dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary()
        for batch in batches:
            said, start = batch.column(1), 0
            while start < batch.num_rows:
                part, size = [], 0
                for t in said.slice(start, rows):  # some megabytes of text at once
                    part.append(t.as_py() or "")
                    size += len(part[-1])
                    if size > 4_000_000:
                        break
                if max(len(held.index), len(held.runs)) > REMEMBERED:
                    held = vocabulary()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), *told(held, part)], [key, *(f.name for f in fields)])
                start += len(part)

    return texts.select(key, F.col(text).alias(f"{key}_text")).mapInArrow(run, T.StructType([texts.schema[key], *fields]))


def _embedded(texts: DataFrame, key: str, text: str, dim: int, field: T.StructField, told: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    """key and what told() makes of the sums."""
    return embedded(texts, key, text, [field], lambda: Vocabulary(dim), lambda held, part: [told(held.sums(part))], dim)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.reshape(-1), kind))


BUCKETS = T.StructField("embedding", T.ArrayType(T.DoubleType()))


def bucket_lists(m: np.ndarray) -> pa.Array:
    return _lists(m.astype(float), pa.float64())


def bucket_vectors(texts: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """key and embedding: the sums themselves as an array of length dim; a null text has zeros."""
    return _embedded(texts, key, text, dim, BUCKETS, bucket_lists)


def bucket_sums(texts: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """key, bucket and value: the sums that aren't zero."""
    sums = bucket_vectors(texts, key, text, dim).select(key, F.posexplode("embedding").alias("bucket", "value"))
    return sums.where(F.col("value") != 0).select(key, F.col("bucket").cast("long").alias("bucket"), F.col("value").cast("long").alias("value"))


def hash_embed(texts: DataFrame, key: str, text: str, dim: int = 1536) -> DataFrame:
    """key and embedding of every text: array<float> of length dim with norm 1, all zeros without tokens."""

    def unit(m: np.ndarray) -> pa.Array:
        norm = np.sqrt((m.astype(float) ** 2).sum(axis=1, keepdims=True))
        return _lists((m / np.where(norm == 0, 1.0, norm)).astype(np.float32), pa.float32())

    return _embedded(texts, key, text, dim, T.StructField("embedding", T.ArrayType(T.FloatType())), unit)
