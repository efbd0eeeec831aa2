"""Packing documents into sequences, shortest pack first over the length histogram (operator 7).

A task tokenises its texts, appends the end id, cuts the ids every `width` ids, and emits one small row per piece:
length, checksum, and its rank among the task's pieces of that length. Only those rows move. The histogram of lengths
(at most `width` entries) goes to the driver, where pieces are placed longest first, each into the shortest pack that
has room; what is kept is how often each pattern of lengths occurs. A piece finds its pattern by its rank among all
pieces of its length: the rank within its task plus the counts of the tasks before. No length, however common, is
gathered in one place.

Defined cases: a null text counts as empty and gives one piece with the end id alone; a text of `width` ids or
more is cut; rows that repeat are packed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from . import textvec as tv
from .op4_bpe import tokenizer_path
from .spaces import documents, materialize, small_batches

WIDTH = 4096
END_ID = 2


def pieces(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, and part and rank, its place among the equally long pieces of its task."""
    kind = dict(docs.dtypes)[id_col]
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, seen = bpe.load(path), TaskContext.get().partitionId(), np.zeros(width + 1, np.int64)
        for batch in batches:
            _, off = tv.text_views(batch.column(1))
            for i, j in tv.chunks(off):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                ids, count = bpe.encode_normalised(cache, texts)
                total = count + 1
                ends = np.cumsum(total)
                flat = np.full(int(ends[-1]), end_id, "<u4")
                keep = np.ones(len(flat), bool)
                keep[ends - 1] = False
                flat[keep] = ids
                n = -(-total // width)
                owner = np.repeat(np.arange(j - i), n)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * width
                length = np.minimum(width, total[owner] - start)
                at = (ends - total)[owner] + start
                crc = [zlib.crc32(flat[a : a + m]) for a, m in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                run_len = length[order]
                first = np.searchsorted(run_len, run_len)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - first + seen[run_len]
                seen += np.bincount(length, minlength=width + 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(owner)), *map(pa.array, (start, length, np.array(crc, np.int64), total[owner], np.full(len(owner), part, np.int64), rank))], names)

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in names[1:]))


def pack_histogram(counts: dict[int, int], width: int = WIDTH) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns as ([(length, how many)], how often), from the number of pieces of each length.

    Lengths go longest first. Packs with the same room and pattern are held together; pieces go to the packs with
    the most room, that is the shortest, and open new ones only where no pack has room.
    """
    rooms: list[int] = []  # ascending
    held: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    full: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def put(pattern: tuple[tuple[int, int], ...], room: int, n: int) -> None:
        if not room:
            full.append((pattern, n))
            return
        if room not in held:
            bisect.insort(rooms, room)
            held[room] = []
        held[room].append((pattern, n))

    def grown(pattern: tuple[tuple[int, int], ...], length: int, k: int) -> tuple[tuple[int, int], ...]:
        return (*pattern[:-1], (length, pattern[-1][1] + k)) if pattern and pattern[-1][0] == length else (*pattern, (length, k))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            pattern, n = held[room].pop()
            if not held[room]:
                held.pop(room)
                rooms.pop()
            used = min(n, left)
            if used < n:
                put(pattern, room, n - used)
            put(grown(pattern, length, 1), room - length, used)
            left -= used
        if left:
            each = width // length
            if left >= each:
                put(((length, each),), width - each * length, left // each)
            if left % each:
                put(((length, left % each),), width - (left % each) * length, 1)
    return [(list(p), n) for p, n in full] + [(list(p), n) for r in rooms for p, n in held[r]]


def segments(patterns: list[tuple[list[tuple[int, int]], int]], width: int = WIDTH) -> dict[str, np.ndarray]:
    """For each length the runs of ranks that a pattern takes: keys sorted by (length, first rank), with the pattern's first sequence, pieces per sequence and offset."""
    taken, rows, sequence = np.zeros(width + 1, np.int64), [], 0
    for pattern, n in patterns:
        offset = 0
        for length, k in pattern:
            rows.append((length, int(taken[length]), sequence, k, offset))
            taken[length] += k * n
            offset += k * length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table.T))


def pack(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    kind = dict(docs.dtypes)[id_col]
    cut = materialize(pieces(docs, path, width, end_id, id_col, text_col), "pieces")
    by_task = materialize(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `width` rows
    runs = docs.sparkSession.sparkContext.broadcast(segments(pack_histogram(histogram, width), width))  # bounded by the patterns, a few per length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # base has a row for each length of each task, so it grows with the input: both sides are dealt, neither is broadcast.
    ranked = cut.join(base.hint("merge"), ["part", "length"]).select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = runs.value
        step = 1 << 40
        keys = t["length"] * step + t["rank"]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            at = np.searchsorted(keys, length * step + rank, side="right") - 1
            nth = rank - t["rank"][at]
            sequence, offset = t["sequence"][at] + nth // t["each"][at], t["offset"][at] + nth % t["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
