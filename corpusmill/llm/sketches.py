"""A count of 64-bit hashes over a whole table in fixed space, to tell which ones may be frequent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .spaces import parts, small_batches

BITS, BLOCK_BITS = 16, 12


def slots(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (tv.mix_with(hashes, 97) >> tv.U64(64 - bits)).astype(np.int64)


def bucket_counts(docs: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], text_col: str = "text", bits: int = BITS) -> np.ndarray:
    """How many of the hashes that `hashes(bytes, offsets)` gives for all texts fall in each of 2**bits buckets.

    A task sends its counters in blocks of 2**BLOCK_BITS, in as few bytes as hold them; blocks are dealt to tasks, which add them up as
    they stream through, one sum for each block however many tasks counted. The driver gets 2**bits counters.
    """
    block = 1 << min(BLOCK_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            buf, off = tv.text_views(batch.column(0))
            for i, j in tv.chunks(off):
                total += np.bincount(slots(hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i]), bits), minlength=1 << bits)
        rows = total.reshape(-1, block)
        some = np.flatnonzero(rows.any(axis=1))
        kinds = [next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if m <= np.iinfo(k).max) for m in rows[some].max(axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[b].astype(k).tobytes() for b, k in zip(some, kinds)], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = counts.as_buffer()
                held[b] = held.get(b, 0) + np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[data.size // block]).astype(np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "counts"])

    each = small_batches(docs.select(text_col)).mapInArrow(count, "block int, counts binary")
    summed = each.repartition(parts(docs.sparkSession), "block").mapInArrow(add, "block int, counts binary").toArrow()
    out = np.zeros(((1 << bits) // block, block), np.int64)
    for b, counts in zip(summed["block"].to_pylist(), summed["counts"]):
        out[b] = np.frombuffer(counts.as_buffer(), np.int64)
    return out.reshape(-1)


def frequent(counts: np.ndarray, times: float = 4.0, least: int = 200) -> np.ndarray:
    """Buckets with more than `times` the mean and `least`: a hash outside them is met no more often than that."""
    return counts > times * counts.mean() + least
