"""Exact dedup against a minimal perfect hash of historical digests (operator 10).

The texts, with every run of ASCII white space as one space, are digested once; from then on only digests move.
Rows up to the median id are the history. Its distinct digests are dealt to shards by hash, and each shard gets a
minimal perfect hash: levels of bit arrays in which every key ends at a place of its own, so that the rank of that
place is its slot. A slot holds the full digest and where its winner is. The distinct digests of the other rows are
looked up and compared byte by byte; members are repeats of history, the rest group among themselves.

Counting and choosing winners is a groupBy with partial aggregation, so a digest that a third of all rows share
sends one row per task. Labelling the rows is a sort-merge join, whose large partitions Spark can split.

Defined cases: null text equals the empty text; of equal texts the smallest id stays, a null id after all others,
and of rows that repeat an id exactly one stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .spaces import documents, drop, free_name, materialize, parts

SPACES = r"[\x20\x09-\x0D]+"
SHARD_DIGESTS = 50_000
INDEX = "shard long, n long, sizes array<long>, bits binary, digests binary, ids binary, rows binary, no_id binary, counts binary"


def normalised(text_col: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Row number, id and 32-byte digest of every row, in the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def distinct(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest: its winner, number of rows and shard."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    return rows.groupBy("digest").agg(first.alias("w"), F.count(F.lit(1)).alias("n")).select(F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"), "digest", "w.id", "w.row", "n")


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lanes = np.ascontiguousarray(digests).view(tv.U64).reshape(len(digests), 4)
    return lanes[:, 0], lanes[:, 1]


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (tv.mix_with(a ^ tv.mix(b), level) % tv.U64(size)).astype(np.int64)


def build(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, all levels' bits and each key's slot, for distinct n x 32 bytes."""
    a, b = _words(digests)
    left, sizes, bits, base, slot = np.arange(len(a)), [], [], 0, np.zeros(len(a), np.int64)
    while len(left):
        size = 2 * len(left) + 8
        at = _place(a[left], b[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        slot[left[mine]] = base + (np.cumsum(alone) - 1)[at[mine]]
        base += int(mine.sum())
        sizes.append(size)
        bits.append(alone)
        left = left[~mine]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), slot


def find(sizes: list[int], bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 where no level claims it; what a slot holds must still be compared."""
    a, b = _words(digests)
    out, left, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
    rank = np.cumsum(bits) - 1
    for level, size in enumerate(sizes):
        at = _place(a[left], b[left], level, size) + base
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return out


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in col), np.uint8).reshape(len(col), 32)


def build_index(history: DataFrame) -> DataFrame:
    """One row per shard with its minimal perfect hash and slots, from what distinct() gives."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = _matrix(pdf["digest"])
        sizes, bits, slot = build(digests)
        back = np.argsort(slot)
        lost = pdf["id"].isna().to_numpy()
        fixed = lambda s: s.to_numpy(np.int64)[back].tobytes()
        return pd.DataFrame(
            [[int(pdf["shard"].iloc[0]), len(pdf), sizes, np.packbits(bits).tobytes(), digests[back].tobytes(), fixed(pdf["id"].fillna(0)), fixed(pdf["row"]), lost[back].astype(np.uint8).tobytes(), fixed(pdf["n"])]],
            columns=["shard", "n", "sizes", "bits", "digests", "ids", "rows", "no_id", "counts"],
        )

    return history.groupBy("shard").applyInPandas(shard, INDEX)


def look_up(fresh: DataFrame, index: DataFrame) -> DataFrame:
    """digest, id, row and n of every fresh digest; where history has it, which `member` tells, id and row are the winner's in its slot, and n counts the rows of both."""

    def shard(new: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = new[["digest", "id", "row", "n"]].copy()
        out["member"] = False
        if len(new) and len(held):
            h = held.iloc[0]
            sizes = [int(x) for x in h["sizes"]]
            digests = _matrix(new["digest"])
            slot = find(sizes, np.unpackbits(np.frombuffer(h["bits"], np.uint8))[: sum(sizes)].astype(bool), digests)
            same = slot >= 0
            same[same] = (np.frombuffer(h["digests"], np.uint8).reshape(-1, 32)[slot[same]] == digests[same]).all(axis=1)
            at, where = slot[same], out.index[same]
            ids = pd.array(np.frombuffer(h["ids"], np.int64)[at], dtype="Int64")
            ids[np.frombuffer(h["no_id"], np.uint8)[at].astype(bool)] = pd.NA
            out["id"] = out["id"].astype("Int64")
            out.loc[where, "id"], out.loc[where, "row"], out.loc[where, "member"] = ids, np.frombuffer(h["rows"], np.int64)[at], True
            out.loc[where, "n"] += np.frombuffer(h["counts"], np.int64)[at]
        return out

    return fresh.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(shard, "digest binary, id long, row long, n long, member boolean")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row, digest, keep_id, group_size and kept of every row of docs."""
    return verdicts(digest_rows(docs, id_col, text_col))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    row = free_name(docs.columns, "row")
    base = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-base")
    rows = materialize(base.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"), F.col(row).alias("row")), "digests")
    return base.join(verdicts(rows).where(~F.col("kept")).select(F.col("row").alias(row)), row, "left_anti").select(*docs.columns)


def verdicts(rows: DataFrame) -> DataFrame:
    """What exact_dedup() returns, from the id, row and digest of every row."""
    spark = rows.sparkSession
    split, total = rows.agg(F.percentile_approx("id", 0.5), F.count(F.lit(1))).first()
    shards = max(parts(spark), -(-total // SHARD_DIGESTS))
    old = F.col("id") <= F.lit(split if split is not None else 0)
    history = distinct(rows.where(old), shards)
    index = materialize(build_index(history), "digest-index")
    found = materialize(look_up(distinct(rows.where(~F.coalesce(old, F.lit(False))), shards), index), "digest-lookups")
    # Members have their verdicts from the slots, nonmembers from their own groups; the history that nothing repeats is left.
    rest = history.join(found.where("member").select("digest"), "digest", "left_anti")
    verdict = found.select("digest", "id", "row", "n").unionByName(rest.select("digest", "id", "row", "n")).select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    # Written first, so that the join has exchanges of its own on both sides and Spark can split a digest with many rows.
    verdict = materialize(verdict, "digest-verdicts")
    drop(index, found)
    return rows.join(verdict, "digest").select("id", "row", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
