"""Approximate dense search over stored indexes: inverted lists with product-quantised residuals, and signatures probed by their margins.

Both are fitted on a bounded sample of the vectors (TRAIN_ROWS), hold every vector, and measure on PILOTS sampled vectors
how far a search must go to find the asked share of the true neighbours; that is stored and used as it is. On clustered vectors a
small part is scored, on vectors without structure most are, and scored_share() and candidate_share() tell how many.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import columns as C
from corpusmill.operators.retrieval import BLOCKS_A_SCAN, CELLS, QUERY_BLOCK, TopPairs, matrix_of, top

TRAIN_ROWS, MOST_LISTS, PILOTS = 50_000, 4096, 300
SUBSPACE, CODEWORDS = 4, 256
SCORED, WAITING = 500_000, 500_000  # scores made at once in a task, and pairs that wait to be ranked
MARGIN = 0.055  # found on the pilots above the share that is asked for


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres of x by Lloyd's rounds; an empty cell takes a row that is far from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = x @ centres.T - 0.5 * (centres * centres).sum(axis=1)
        at = near.argmax(axis=1)
        many = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        full = many > 0
        centres[full] = total[full] / many[full, None]
        if not full.all():
            centres[~full] = x[np.argsort(near.max(axis=1))[: int((~full).sum())]]
    return centres


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))


def _sampled(vectors: DataFrame, rows: int) -> pa.Table:
    """The vectors with the smallest hashes of their ids."""
    return vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(rows).toArrow().combine_chunks()


def _matrix(table: pa.Table, column: str = "embedding") -> np.ndarray:
    return unit_rows(matrix_of(table[column].combine_chunks())) if table.num_rows else np.zeros((0, 1))


def _neighbours(vectors: DataFrame, pilots: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pilots' numbers and the unit vectors of their k true neighbours each, the pilot itself left out."""
    from corpusmill.operators.retrieval import dense_topk

    spark = vectors.sparkSession
    asked = spark.createDataFrame(pilots.rename_columns(["query_id", "embedding"]))
    best = dense_topk(asked, vectors, k + 1).where(F.col("query_id") != F.col("chunk_id")).select("query_id", "chunk_id")
    found = best.join(vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")), "chunk_id").select("query_id", "embedding").toArrow().combine_chunks()  # PILOTS * (k + 1) rows
    if not found.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    place = {q: i for i, q in enumerate(pilots["chunk_id"].to_pylist())}
    return np.array([place[q] for q in found["query_id"].to_pylist()]), _matrix(found)


def _least(ranks: np.ndarray, share: float, most: int) -> int:
    """How many steps find the share of neighbours that were met at these steps (from 0)."""
    if not len(ranks):
        return most
    return int(min(np.sort(ranks)[min(int(np.ceil(share * len(ranks))), len(ranks)) - 1] + 1, most))


class _Stored:
    """A model in a file of one row, and a table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.model = pickle.loads(bytes(spark.read.parquet(f"{path}/model").first()["model"]))
        self.table = spark.read.parquet(f"{path}/vectors") if self.model["rows"] else None

    @staticmethod
    def keep(spark: SparkSession, path: str, model: dict) -> None:
        spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary").coalesce(1).write.parquet(f"{path}/model")

    def blocks(self, queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Ids and unit vectors of the questions, a counted, bounded part of them at once."""
        q = _usable(queries).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        scans = max(-(-q.count() // (QUERY_BLOCK * BLOCKS_A_SCAN)), 1)
        for part in range(scans):
            rows = (q if scans == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == part)).toArrow().combine_chunks()
            if rows.num_rows:
                yield rows["query_id"].combine_chunks(), _matrix(rows)


class Ivf(_Stored):
    def _probed(self, q: np.ndarray) -> np.ndarray:
        return np.argsort(-(q @ self.model["centres"].T), axis=1, kind="stable")[:, : self.model["probe"]]

    def scored_share(self, queries: DataFrame) -> float:
        """The share of all pairs of questions and vectors whose codes are scored."""
        met = asked = 0
        for _, q in self.blocks(queries):
            met += int(self.model["sizes"][self._probed(q)].sum())
            asked += len(q)
        return met / max(asked * self.model["rows"], 1)


def build_ivf(vectors: DataFrame, path: str, k: int = 10, recall: float = 0.9, lists: int | None = None, seed: int = 7) -> Ivf:
    """Writes an index of vectors (chunk_id, embedding) at path: as many lists as the square root of the rows, at most MOST_LISTS.

    Rows without a vector, or with zeros only, are like none and left out. A row holds its unit vector and the codes of
    what its list's centre leaves of it; a list is a folder, so a search reads the lists it probes.
    """
    spark, vectors = vectors.sparkSession, _usable(vectors)
    n, sample = vectors.count(), _sampled(vectors, TRAIN_ROWS)
    x = _matrix(sample)
    if not n:
        _Stored.keep(spark, path, {"rows": 0})
        return Ivf(spark, path)
    lists = max(1, min(lists or int(np.sqrt(n)), MOST_LISTS, len(x)))
    centres = unit_rows(kmeans(x, lists, seed))
    left = x - centres[(x @ centres.T).argmax(axis=1)]
    cuts = list(range(0, x.shape[1], SUBSPACE))
    books = [kmeans(left[:, c : c + SUBSPACE], min(CODEWORDS, len(x)), seed + 1 + c) for c in cuts]
    shared = spark.sparkContext.broadcast((centres, books))  # at most MOST_LISTS centres
    schema = T.StructType([vectors.schema["chunk_id"], T.StructField("list_id", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("code", T.BinaryType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit_rows(matrix_of(batch.column(1)))
            at = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(v, -(-len(v) * len(centres) // CELLS))])
            rest = v - centres[at]
            code = np.stack([(rest[:, c : c + SUBSPACE] @ b.T - 0.5 * (b * b).sum(axis=1)).argmax(axis=1) for c, b in zip(cuts, books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.astype(np.float32).reshape(-1))), pa.array([c.tobytes() for c in code], pa.binary())], schema.names)

    rows = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(assign, schema)
    # A list of any size is dealt to tasks by its rows' ids as well.
    rows.repartition("list_id", F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, n // lists // 1_000_000)))).write.partitionBy("list_id").parquet(f"{path}/vectors")
    sizes = np.zeros(lists, np.int64)
    for r in spark.read.parquet(f"{path}/vectors").groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each list
        sizes[r["list_id"]] = r["n"]
    pilots = sample.slice(0, PILOTS)
    of, near = _neighbours(vectors, pilots, k)
    order = np.argsort(np.argsort(-(_matrix(pilots) @ centres.T), axis=1, kind="stable"), axis=1)  # a list's place among the nearest
    ranks = order[of, (near @ centres.T).argmax(axis=1)] if len(of) else np.zeros(0)
    _Stored.keep(spark, path, {"rows": n, "centres": centres, "books": books, "cuts": cuts, "sizes": sizes, "probe": _least(ranks, recall + MARGIN, lists)})
    return Ivf(spark, path)


def ivf_topk(queries: DataFrame, index: Ivf, k: int, again: int = 12) -> DataFrame:
    """query_id, chunk_id, similarity and rank: codes of the probed lists are scored, and the again * k best of each question exactly."""
    kind, m = queries.schema["query_id"], index.model
    fields = T.StructType([kind, T.StructField("chunk_id", index.table.schema["chunk_id"].dataType if m["rows"] else T.LongType()), T.StructField("list_id", T.IntegerType()), T.StructField("near", T.DoubleType())])
    found = []
    for ids, q in index.blocks(queries) if m["rows"] else ():
        probed = index._probed(q)
        asked = np.zeros((len(m["centres"]), len(q)), bool)
        asked[probed.T, np.arange(len(q))] = True
        lists = [int(x) for x in np.flatnonzero(asked.any(axis=1))]
        shared = index.spark.sparkContext.broadcast((ids, q, np.packbits(asked, axis=1), m["centres"], m["books"]))  # a bit for each list and question

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, asked, centres, books = shared.value
            best, waiting = TopPairs(len(q), again * k), []

            def rank() -> None:
                if waiting:
                    a, near, held, x = zip(*waiting)
                    best.add(np.concatenate(a), np.concatenate(near), pa.concat_arrays(held), np.concatenate(x))
                    waiting.clear()

            for batch in batches:
                which = batch.column(1).to_numpy()
                for x in np.unique(which):
                    rows, mine = np.flatnonzero(which == x), np.flatnonzero(np.unpackbits(asked[x], count=len(q)))
                    code = np.frombuffer(b"".join(batch.column(2).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1)
                    told = centres[x] + np.concatenate([b[code[:, s]] for s, b in enumerate(books)], axis=1)  # the vectors that the codes stand for
                    step = max(1, SCORED // len(rows))
                    for low in range(0, len(mine), step):
                        some = mine[low : low + step]
                        near = q[some] @ told.T
                        a, b = np.nonzero(near >= best.least[some][:, None])
                        waiting.append((some[a], near[a, b], batch.column(0).take(pa.array(rows[b])), np.full(len(a), x)))
                        if sum(len(w[0]) for w in waiting) > WAITING:
                            rank()
            rank()
            if best.ids is not None:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.asked)), best.ids, pa.array(best.extra.astype(np.int32)), pa.array(best.alike)], fields.names)

        rows = index.table.where(F.col("list_id").isin(lists))  # folders of other lists aren't read
        near = rows.select("chunk_id", F.col("list_id").cast("int").alias("list_id"), "code").mapInArrow(run, fields)
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id"))
        near = near.withColumn("nth", nth).where(F.col("nth") <= again * k).select("query_id", "chunk_id", "list_id")
        found.append(near.join(rows.select("chunk_id", "list_id", "embedding"), ["list_id", "chunk_id"]))
    if not found:
        return index.spark.createDataFrame([], T.StructType([*fields[:2], T.StructField("similarity", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    exact = reduce(DataFrame.unionByName, found).join(queries.select("query_id", F.col("embedding").alias("__q")), "query_id")
    return top(exact.select("query_id", "chunk_id", F.round(C.cosine(F.col("embedding"), F.col("__q")), 12).alias("similarity")), "similarity", k)


class Lsh(_Stored):
    def probed(self, q: np.ndarray) -> np.ndarray:
        """For each question and band, which of the band's 2**bits signatures are probed."""
        order, probe = _probe_order(q, self.model["planes"]), self.model["probe"]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order[:, :, :probe], True, axis=2)
        return out

    def candidate_share(self, queries: DataFrame) -> float:
        """The share of all pairs of questions and vectors that are scored."""
        rows = self.table.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).toArrow()
        sig, n = matrix_of(rows["sig"].combine_chunks()).astype(np.int64), rows["n"].to_numpy()
        met = asked = 0
        for _, q in self.blocks(queries):
            may = self.probed(q)
            met += sum(int(n[reduce(np.logical_or, (may[i, b][sig[:, b]] for b in range(sig.shape[1])))].sum()) for i in range(len(q)))
            asked += len(q)
        return met / max(asked * self.model["rows"], 1)


def _margins(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Signed distances of each vector to the planes of each band."""
    return np.einsum("nd,bkd->nbk", v, planes)


def _signatures(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return ((_margins(v, planes) >= 0) << np.arange(planes.shape[1])).sum(axis=2)


def _probe_order(q: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For each question and band all signatures, by what changing the question's own into them costs: the squares of the margins crossed."""
    m = _margins(q, planes)
    flips = np.array(list(itertools.product((0, 1), repeat=planes.shape[1])))[:, ::-1]
    cost = np.einsum("nbk,fk->nbf", m * m, flips)
    code = (flips << np.arange(planes.shape[1])).sum(axis=1)
    return _signatures(q, planes)[:, :, None] ^ code[np.argsort(cost, axis=2, kind="stable")]


def build_lsh(vectors: DataFrame, path: str, k: int = 10, recall: float = 0.9, bands: int = 4, bits: int = 8, seed: int = 11) -> Lsh:
    """Writes vectors with a signature for each band: the sides of `bits` planes on which they lie, orthogonal ones as far as the dimensions reach."""
    spark, vectors = vectors.sparkSession, _usable(vectors)
    n, sample = vectors.count(), _sampled(vectors, PILOTS)
    if not n:
        _Stored.keep(spark, path, {"rows": 0})
        return Lsh(spark, path)
    pilots, rng = _matrix(sample), np.random.default_rng(seed)
    dim = pilots.shape[1]
    planes = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bands * bits // dim))])[: bands * bits].reshape(bands, bits, dim)
    schema = T.StructType([vectors.schema["chunk_id"], T.StructField("sig", T.ArrayType(T.IntegerType())), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = unit_rows(matrix_of(batch.column(1)))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1))) for x in (_signatures(v, planes).astype(np.int32), v.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], schema.names)

    vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(sign, schema).write.parquet(f"{path}/vectors")
    of, near = _neighbours(vectors, sample, k)
    rank = np.argsort(_probe_order(pilots, planes), axis=2)  # place of every signature in the order of probing
    ranks = np.array([min(rank[i, b, s[b]] for b in range(bands)) for i, s in zip(of, _signatures(near, planes))]) if len(of) else np.zeros(0)
    _Stored.keep(spark, path, {"rows": n, "planes": planes, "probe": _least(ranks, recall + MARGIN, 1 << bits)})
    return Lsh(spark, path)


def lsh_topk(queries: DataFrame, index: Lsh, k: int) -> DataFrame:
    """query_id, chunk_id, similarity and rank: vectors in a probed signature of any band are scored exactly, each once."""
    kind = queries.schema["query_id"]
    fields = T.StructType([kind, T.StructField("chunk_id", index.table.schema["chunk_id"].dataType if index.model["rows"] else T.LongType()), T.StructField("similarity", T.DoubleType())])
    found = []
    for ids, q in index.blocks(queries) if index.model["rows"] else ():
        shared = index.spark.sparkContext.broadcast((ids, q, index.probed(q)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, may = shared.value
            best = TopPairs(len(q), k)
            for batch in batches:
                sig, v = matrix_of(batch.column(1)).astype(np.int64), matrix_of(batch.column(2)).astype(float)
                step = max(1, CELLS // max(len(v), 1))
                for low in range(0, len(q), step):
                    some = slice(low, low + step)
                    met = reduce(np.logical_or, (may[some, b][:, sig[:, b]] for b in range(sig.shape[1])))
                    a, b = np.nonzero(met)
                    near = np.round(np.einsum("ij,ij->i", q[some][a], v[b]), 12)
                    good = near >= best.least[some][a]
                    best.add(a[good] + low, near[good], batch.column(0).take(pa.array(b[good])))
            if best.ids is not None:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.asked)), best.ids, pa.array(best.alike)], fields.names)

        found.append(index.table.select("chunk_id", "sig", "embedding").mapInArrow(run, fields))
    return top(reduce(DataFrame.unionByName, found) if found else index.spark.createDataFrame([], fields), "similarity", k)
