"""Document fingerprints by a homomorphic multiset hash (operator 5).

A paragraph is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs' vectors, so it does
not depend on their order, and a paragraph is inserted or deleted by adding or subtracting its vector. The vector has
two parts. EXACT lanes of 64 bits, modulo 2**64, are independent hashes of the whole paragraph: equal multisets have
equal lanes and others practically never. SKETCH lanes of 16 bits, modulo 2**16, sum the signed hashes of the
paragraph's shingles of SHINGLE words, the first, second, ... time they occur in it; the difference of two fingerprints is then the sketch of the differing shingles,
and its squared length estimates how many there are. Likeness is 1 - |a - b|**2 / (|a|**2 + |b|**2), at least 0, and 1
for equal fingerprints only where all lanes agree.

Paragraphs are the lines of a text that hold a word; white space inside one does not count. Defined cases: a null
text counts as empty; null ids come first, rows that repeat an id are ordered by text and each is the next document of the
one before; the empty text's fingerprint is all zeros; two empty ones are alike (1), an empty and another
one are not (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .spaces import documents, parts, small_batches

EXACT, SKETCH, SHINGLE = 4, 128, 3


def vectors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EXACT lanes (uint64) and SKETCH lanes (uint16) of each text."""
    n = len(offsets) - 1
    exact, sketch = np.zeros((n, EXACT), tv.U64), np.zeros((n, SKETCH), np.uint16)
    starts, ends, first = tv.ascii_words(buf, offsets)
    if not len(starts):
        return exact, sketch
    doc = np.repeat(np.arange(n), np.diff(first))
    word = tv.span_hash(tv.prefix_hash(buf), starts, ends)
    lines = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    new = np.ones(len(starts), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lines[starts[1:]] != lines[ends[:-1]])
    head = np.flatnonzero(new)
    line = np.cumsum(new) - 1
    place = np.arange(len(word)) - head[line]
    pw, _ = tv.powers(int(place.max()) + 1)
    whole = np.add.reduceat(word * pw[place], head)
    owner = doc[head]
    edge = np.searchsorted(owner, np.arange(n))
    full = np.flatnonzero(np.bincount(owner, minlength=n))
    for k in range(EXACT):
        exact[full, k] = np.add.reduceat(tv.mix_with(whole, 11 + k), edge[full])
    # Shingles stay inside their paragraph; a shorter paragraph is one shingle.
    last = np.append(head[1:], len(word)) - 1
    room = last[line] - np.arange(len(word))
    at = np.flatnonzero((room >= SHINGLE - 1) | new)
    mixed = np.zeros(len(at), tv.U64)
    for k in range(SHINGLE):
        inside = at + k <= last[line[at]]
        mixed = tv.mix(mixed + np.where(inside, word[np.minimum(at + k, len(word) - 1)], tv.U64(k)))
    # The second, third, ... time that a shingle stands in a paragraph is another feature, so repeats don't outweigh the rest.
    key = mixed ^ tv.mix(line[at].astype(tv.U64))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    place = np.arange(len(at))
    nth = np.empty(len(at), np.int64)
    nth[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    mixed = np.where(nth > 0, tv.mix(mixed + nth.astype(tv.U64) * tv.U64(tv.MULTIPLIER)), mixed)
    lane = (mixed >> tv.U64(57)).astype(np.int64) % SKETCH
    sign = np.where(mixed & tv.U64(1), 1.0, -1.0)
    total = np.bincount(doc[at] * SKETCH + lane, weights=sign, minlength=n * SKETCH)
    return exact, total.astype(np.int64).reshape(n, SKETCH).astype(np.uint16)


def join_lanes(exact: np.ndarray, sketch: np.ndarray) -> list[str]:
    raw = np.concatenate([exact.astype("<u8").view(np.uint8).reshape(len(exact), -1), sketch.astype("<u2").view(np.uint8).reshape(len(sketch), -1)], axis=1)
    return [r.tobytes().hex() for r in raw]


def split_lanes(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(map(bytes.fromhex, prints)), np.uint8).reshape(len(prints), EXACT * 8 + SKETCH * 2)
    return np.ascontiguousarray(raw[:, : EXACT * 8]).view("<u8"), np.ascontiguousarray(raw[:, EXACT * 8 :]).view("<u2")


def add(a: str, b: str, sign: int = 1) -> str:
    """Fingerprint of both texts' paragraphs together, or with sign -1 of a's without b's."""
    (ea, sa), (eb, sb) = split_lanes([a]), split_lanes([b])
    return join_lanes(ea + eb if sign > 0 else ea - eb, sa + sb if sign > 0 else sa - sb)[0]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Row by row, from 0 to 1."""
    signed = lambda x: x.view(np.int16).astype(np.float64)
    sa, sb = a[1].astype(np.uint16), b[1].astype(np.uint16)
    apart = (signed(sa - sb) ** 2).sum(axis=1)
    size = (signed(sa) ** 2).sum(axis=1) + (signed(sb) ** 2).sum(axis=1)
    near = np.clip(1 - apart / np.maximum(size, 1), 0, 1)
    same = (a[0] == b[0]).all(axis=1) & (sa == sb).all(axis=1)
    empty = ~a[0].any(axis=1) | ~b[0].any(axis=1)
    return np.where(same, 1.0, np.where(empty, 0.0, np.minimum(near, 1 - 1e-9)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint (hex) of every text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tv.text_views(batch.column(1))
            for i, j in tv.chunks(off):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(join_lanes(*vectors(buf[off[i] : off[j]], off[i : j + 1] - off[i])), pa.string())], [id_col, "fingerprint"])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def _search(col: F.Column, cuts: list[int]) -> F.Column:
    """Number of cuts that are at most col, by binary search in an array."""
    bits = len(cuts).bit_length()
    held = F.array(*map(F.lit, [*cuts, *[(1 << 63) - 1] * ((1 << bits) - 1 - len(cuts))])).cast("array<long>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(bits))))
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.element_at(held, low + step) <= col, low + step).otherwise(low))
    return F.least(found, F.lit(len(cuts)))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows bucket, guest, id, text: dealt by ranges of ids, sorted, every bucket followed by a guest, the first row of the next bucket.

    The cuts are quantiles of the ids, which are ids themselves, so each cut is the first row of its bucket and only one
    row per bucket is sent twice. The last bucket's guest is the first row of all. Null ids come first; rows that
    repeat an id are ordered by text.
    """
    n = parts(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, nulls, cuts = rows.agg(F.min("id"), F.count_if(F.col("id").isNull()), F.percentile_approx("id", [k / (4 * n) for k in range(1, 4 * n)], 100 * n)).first()
    cuts = sorted({c for c in cuts or [] if c > low})
    bucket = F.coalesce(_search(F.col("id"), cuts), F.lit(0)) if cuts else F.lit(0)
    first = F.col("id").isNull() if nulls else F.col("id") == F.lit(low)
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("guest"))
    to_last = F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(True).alias("guest"))
    to_before = F.struct((bucket - 1).alias("bucket"), F.lit(True).alias("guest"))
    target = F.when(F.coalesce(first, F.lit(False)), F.array(own, to_last))
    if cuts:
        target = target.when(F.coalesce(F.col("id").isin(cuts), F.lit(False)), F.array(own, to_before))
    dealt = rows.select("id", "text", F.explode(target.otherwise(F.array(own))).alias("to")).select("to.bucket", "to.guest", "id", "text")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "id", "text")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has the last quarter of the code points replaced by as many first ones of the next document.
    """
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0] if len(batch) else held
            if rows is None or len(rows) < 2:
                held = rows
                continue
            held = rows.slice(len(rows) - 1)
            _, off = tv.text_views(rows.column(3).slice(0, len(rows) - 1))
            guest = rows.column(1).to_numpy(zero_copy_only=False)
            for i, j in tv.chunks(off):
                if not guest[i:j].all():  # a long guest may be a slice of its own, which pairs with nothing
                    yield pair_up(rows.slice(i, j - i + 1))

    def pair_up(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(3).to_pylist()
        real = np.flatnonzero(~rows.column(1).to_numpy(zero_copy_only=False)[:-1])
        size = [len(texts[i]) for i in real]
        new = [texts[i][: n - n // 4] + texts[i + 1][: n // 4] for i, n in zip(real, size)]
        exact, sketch = vectors(*tv.text_views(rows.column(3)))
        e_exact, e_sketch = vectors(*tv.text_views(pa.array(new, pa.large_string())))
        own = exact[real], sketch[real]
        return pa.RecordBatch.from_arrays(
            [rows.column(2).take(pa.array(real)), pa.array(size, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()), pa.array(join_lanes(*own), pa.string()), pa.array(join_lanes(e_exact, e_sketch), pa.string()), pa.array(likeness(own, (e_exact, e_sketch))), pa.array(likeness(own, (exact[real + 1], sketch[real + 1])))],
            names,
        )

    return small_batches(with_next(docs, id_col, text_col)).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
