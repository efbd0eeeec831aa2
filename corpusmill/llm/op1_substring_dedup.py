"""Substring dedup by sliding sentence spans (operator 1).

A text is cut into sentences: at a word that ends in . ! or ?, at a line's end, and, in sentences of more than
LONG words, after the word of the least hash in every WINDOW words, so that a passage lines up again within WINDOW
words wherever it was put in: one of over 50 words keeps 27 that are cut alike everywhere, in pieces of at most 12. From
every sentence on, the shortest run of at least RUN sentences and MIN_WORDS words is hashed (96 bits). Equal runs meet
by a join over the whole corpus; all but the first, by id and place, are repeats, and sentences that a repeat covers
are removed with the white space after them.

A run that a large part of all rows share doesn't meet in one task: a count of run hashes in fixed space tells which
may be frequent, and those are dealt by hash and a salt of the row first; what comes first under its salt, one row per
salt at most, meets by hash alone. The rest is dealt by hash at once.

Defined cases: a null text stays null, an empty one empty; texts of fewer than RUN sentences or MIN_WORDS words have no
run and stay; of rows that repeat an id the first by row number counts as earlier; null ids come last; an empty table
gives no rows; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .sketches import bucket_counts, frequent, slots
from .spaces import documents, free_name, materialize, parts, small_batches

RUN, MIN_WORDS, LONG, WINDOW = 3, 16, 12, 12
MOST_BITS = 22  # of the count that tells frequent runs; fewer where there are fewer rows


def _sliding(x: np.ndarray, n: int, least: Callable) -> np.ndarray:
    """The minimum or maximum of every n neighbours."""
    width = 1
    while width < n:
        step = min(width, n - width)
        x = least(x[:-step], x[step:])
        width += step
    return x


def _markers(word: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Whether a word has the least hash in any WINDOW words of its sentence; all of equal ones have."""
    if len(word) < WINDOW:
        return np.zeros(len(word), bool)
    h = word | tv.U64(1)
    least = np.where(sentence[: len(word) - WINDOW + 1] == sentence[WINDOW - 1 :], _sliding(h, WINDOW, np.minimum), tv.U64(0))
    return _sliding(np.pad(least, WINDOW - 1), WINDOW, np.maximum) == h


def _sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each sentence and one past its last, the first sentence of each text, words' starts and hashes."""
    starts, ends, first = tv.ascii_words(buf, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64), starts, np.zeros(0, tv.U64)
    word = tv.span_hash(tv.prefix_hash(buf), starts, ends)
    kind = tv.byte_classes(buf)
    place = np.arange(len(buf))
    sign = np.maximum.accumulate(np.where((kind == tv.LETTER) | (kind == tv.NUMBER), place, -1))
    stop = np.maximum.accumulate(np.where((buf == 0x2E) | (buf == 0x21) | (buf == 0x3F), place, -1))
    over = (stop[ends - 1] >= starts) & (stop[ends - 1] > sign[ends - 1])
    lines = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    over[:-1] |= lines[starts[1:]] != lines[ends[:-1]]
    last = first[1:][np.diff(first) > 0] - 1
    over[last] = True
    closing = np.flatnonzero(over)
    length = np.diff(np.concatenate([[-1], closing]))
    over |= np.repeat(length > LONG, length) & _markers(word, np.repeat(np.arange(len(length)), length))
    end = np.flatnonzero(over) + 1
    begin = np.concatenate([[0], end[:-1]])
    return begin, end, np.searchsorted(begin, first), starts, word


def _runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run: its text, first sentence within the text, number of sentences, and two hashes."""
    begin, end, first, _, word = _sentences(buf, offsets)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, tv.U64), np.zeros(0, tv.U64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    here = np.arange(len(begin))
    to = np.maximum(here + RUN - 1, np.searchsorted(end, begin + MIN_WORDS))
    fits = to < first[1:][text]
    here, to, text = here[fits], to[fits], text[fits]
    pw, inv = tv.powers(len(word))
    hashes = []
    for seed in (0, 1):
        w = tv.mix_with(word, seed)
        total = np.concatenate([np.zeros(1, tv.U64), np.cumsum(w * pw[: len(w)])])
        hashes.append(tv.mix((total[end[to]] - total[begin[here]]) * inv[begin[here]] + (end[to] - begin[here]).astype(tv.U64)))
    return text, here - first[text], to - here + 1, hashes[0], hashes[1]


def runs(base: DataFrame, id_col: str, row_col: str, text_col: str, hot: np.ndarray, want_hot: bool) -> DataFrame:
    """h1, h2, id, row, at of the runs that are in frequent buckets, or of the others; at holds first sentence and count."""
    bits = len(hot).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tv.text_views(batch.column(2))
            for i, j in tv.chunks(off):
                text, at, count, h1, h2 = _runs(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                keep = np.flatnonzero(hot[slots(h1, bits)] == want_hot)
                rows = pa.array(text[keep] + i)
                yield pa.RecordBatch.from_arrays([pa.array(h1[keep].view(np.int64)), pa.array((h2[keep] >> tv.U64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((at[keep] << 20) | np.minimum(count[keep], (1 << 20) - 1))], ["h1", "h2", "id", "row", "at"])

    return small_batches(base.select(F.col(id_col).cast("long"), row_col, text_col)).mapInArrow(run, "h1 long, h2 int, id long, row long, at long")


def repeats(base: DataFrame, id_col: str, row_col: str, text_col: str) -> DataFrame:
    """row and at of every run that is not the first of its kind."""
    bits = min(max(16, base.count().bit_length() - 6), MOST_BITS)
    hot = frequent(bucket_counts(base, lambda buf, off: _runs(buf, off)[3], text_col, bits))
    order = [F.col("id").isNull(), F.col("id"), F.col("row"), F.col("at")]
    place = Window.partitionBy("h1", "h2").orderBy(*order)
    cold = runs(base, id_col, row_col, text_col, hot, False).withColumn("nth", F.row_number().over(place)).where(F.col("nth") > 1).select("row", "at")
    if not hot.any():
        return cold
    salt = F.pmod(F.xxhash64("row"), F.lit(parts(base.sparkSession)))
    apart = Window.partitionBy("h1", "h2", salt).orderBy(*order)
    many = materialize(runs(base, id_col, row_col, text_col, hot, True).withColumn("nth", F.row_number().over(apart)), "frequent-runs")
    firsts = many.where(F.col("nth") == 1).withColumn("nth", F.row_number().over(place))
    return cold.unionByName(many.where(F.col("nth") > 1).select("row", "at")).unionByName(firsts.where(F.col("nth") > 1).select("row", "at"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with repeated sentences removed from the text, and n_sentences and n_removed (with _ in front where docs has such columns)."""
    n_all, n_gone, row, spans_col = (free_name(docs.columns, c) for c in ("n_sentences", "n_removed", "row", "spans"))
    base = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "substring-base")
    spans = repeats(base, id_col, row, text_col).groupBy(F.col("row").alias(row)).agg(F.collect_set("at").alias(spans_col))  # bounded by one text's sentences
    joined = base.join(spans, row, "left").select(*docs.columns, spans_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tv.text_views(batch.column(at))
            spans = batch.column(len(batch.columns) - 1)
            for i, j in tv.chunks(off):
                part, bounds = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                begin, _, first, starts, _ = _sentences(part, bounds)
                total, gone, texts = np.diff(first), np.zeros(j - i, np.int64), []
                for k, (text, cut) in enumerate(zip(batch.column(at).slice(i, j - i).to_pylist(), spans.slice(i, j - i).to_pylist())):
                    if cut:
                        texts.append(_without(part, bounds[k], bounds[k + 1], starts[begin[first[k] : first[k + 1]]], np.array(cut, np.int64), gone, k))
                    else:
                        texts.append(text)
                cols = [c.slice(i, j - i) for c in batch.columns[:-1]]
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(total), pa.array(gone)], [*batch.schema.names[:-1], n_all, n_gone])

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema.fields), T.StructField(n_all, T.LongType()), T.StructField(n_gone, T.LongType())])
    return small_batches(joined).mapInArrow(run, schema)


def _without(buf: np.ndarray, low: int, high: int, heads: np.ndarray, cut: np.ndarray, gone: np.ndarray, k: int) -> str:
    """The text buf[low:high], whose sentences start at heads, without those that the runs in cut cover."""
    depth = np.zeros(len(heads) + 1, np.int64)
    np.add.at(depth, cut >> 20, 1)
    np.add.at(depth, np.minimum((cut >> 20) + (cut & ((1 << 20) - 1)), len(heads)), -1)
    covered = np.cumsum(depth)[:-1] > 0
    gone[k] = covered.sum()
    edges = np.append(heads, high)
    parts = [buf[low : heads[0]].tobytes(), *(buf[edges[s] : edges[s + 1]].tobytes() for s in np.flatnonzero(~covered))]
    return b"".join(parts).decode("utf-8", "replace")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
