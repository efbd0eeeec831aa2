"""Ranked retrieval for tables of questions: dense, lexical and hybrid, exact and approximate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import columns as C

RRF_K, PER_ARM, KEEP = 60, 40, 12
QUERY_BLOCK, BLOCKS_A_SCAN = 5_000, 4
CELLS = 2_000_000  # similarities held at once in a task
PIVOTS, ALIKE = 32, 32  # pivots of a block of questions; questions that meet a slice together


def top(run: DataFrame, score: str, k: int, rank: str = "rank", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each query with their rank; equal scores go by the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return run.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def maybe_broadcast(df: DataFrame, rows: int = QUERY_BLOCK) -> DataFrame:
    """df, marked for broadcast only if it has been counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class _Block:
    """Vectors of a block of questions, by group, with their norms."""

    def __init__(self, ids: pa.Array, groups: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.members = {g: np.flatnonzero((groups == g) & (self.norms > 0)) for g in np.unique(groups)}


def matrix_of(col: pa.Array) -> np.ndarray:
    """Equally long lists as rows."""
    if not len(col):
        return np.zeros((0, 1))
    first, last = col.offsets[0].as_py(), col.offsets[len(col)].as_py()
    return col.values.slice(first, last - first).to_numpy(zero_copy_only=False).reshape(len(col), -1)


class TopPairs:
    """Each question's k best rows so far: by falling similarity, of equal ones the smaller id; ids may carry a number along."""

    def __init__(self, questions: int, k: int):
        self.k, self.least = k, np.full(questions, -np.inf)
        self.asked, self.alike, self.extra, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), None

    def add(self, asked: np.ndarray, alike: np.ndarray, ids: pa.Array, extra: np.ndarray | None = None) -> None:
        """Adds pairs and drops all that k better ones of the same question are there for."""
        if not len(asked):
            return
        asked, alike = np.concatenate([self.asked, asked]), np.concatenate([self.alike, alike])
        extra = np.concatenate([self.extra, extra]) if extra is not None else np.zeros(len(asked), np.int64)
        ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        order = pc.sort_indices(pa.table({"a": asked, "s": alike, "i": ids}), [("a", "ascending"), ("s", "descending"), ("i", "ascending")]).to_numpy()
        asked, alike = asked[order], alike[order]
        good = np.arange(len(asked)) - np.searchsorted(asked, asked) < self.k
        self.asked, self.alike, self.extra, self.ids = asked[good], alike[good], extra[order[good]], ids.take(pa.array(order[good]))
        full = np.flatnonzero(np.bincount(self.asked, minlength=len(self.least)) >= self.k)
        self.least[full] = self.alike[np.searchsorted(self.asked, full, side="right") - 1]


class _Best(TopPairs):
    """The best rows of one block of questions."""

    def __init__(self, block: _Block, k: int, overlapping: bool, places: int):
        super().__init__(len(block.vectors), k)
        self.block, self.overlapping, self.places = block, overlapping, places

    def meet(self, ids: pa.Array, groups: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        for g in np.unique(groups):
            asked = self.block.members.get(g)
            rows = np.flatnonzero((groups == g) & (norms > 0))
            if asked is None or not len(asked):
                continue
            step = max(1, CELLS // len(asked))
            for low in range(0, len(rows), step):
                part = rows[low : low + step]
                q, c = self.block.vectors[asked], vectors[part]
                alike = np.round((q @ c.T) / (self.block.norms[asked][:, None] * norms[part][None, :]), self.places)
                if self.overlapping and (alike == 0).any():
                    alike[(alike == 0) & ((np.abs(q) @ np.abs(c).T) == 0)] = -np.inf
                x, y = np.nonzero((alike >= self.least[asked][:, None]) & (alike > -np.inf))
                self.add(asked[x], alike[x, y], ids.take(pa.array(part[y])))

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            yield pa.RecordBatch.from_arrays([self.block.ids.take(pa.array(self.asked)), self.ids, pa.array(self.alike)], names)


def far_apart(vectors: np.ndarray, most: int) -> np.ndarray:
    """Some of the unit vectors, each the one farthest from those before it."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(most, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


class _Within(_Best):
    """The best rows of a block of questions at a similarity of at least `least`.

    A row is told by its angle to the nearest pivot, which is one of the questions. Angles obey the triangle inequality, so a question
    and a row whose angles to a pivot differ by more than the angle of `least` are not compared: of the rows of each pivot, sorted by
    angle, a run of questions with angles alike meets one slice. `met` counts the pairs compared.
    """

    def __init__(self, block: _Block, k: int, places: int, least: float, met: Accumulator | None):
        super().__init__(block, k, False, places)
        self.floor, self.counted = least, met
        self.reach = np.arccos(np.clip(least, -1, 1)) + 1e-7
        self.unit = block.vectors / np.where(block.norms == 0, 1.0, block.norms)[:, None]
        self.pivots = {g: far_apart(self.unit[m], PIVOTS) for g, m in block.members.items() if len(m)}
        self.angles = {g: np.arccos(np.clip(self.unit[self.block.members[g]] @ p.T, -1, 1)) for g, p in self.pivots.items()}

    def meet(self, ids: pa.Array, groups: np.ndarray, vectors: np.ndarray) -> None:
        norms, met = np.sqrt((vectors * vectors).sum(axis=1)), 0
        for g in np.unique(groups):
            if g not in self.pivots:
                continue
            rows, asked = np.flatnonzero((groups == g) & (norms > 0)), self.block.members[g]
            unit = vectors[rows] / norms[rows][:, None]
            near = unit @ self.pivots[g].T
            owner = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(rows)), owner], -1, 1))
            for p in np.unique(owner):
                mine = np.flatnonzero(owner == p)
                mine = mine[np.argsort(angle[mine], kind="stable")]
                held, order = angle[mine], np.argsort(self.angles[g][:, p], kind="stable")
                for some in np.array_split(order, -(-len(order) // ALIKE)):
                    of = self.angles[g][some, p]
                    low, high = np.searchsorted(held, of[0] - self.reach), np.searchsorted(held, of[-1] + self.reach, side="right")
                    for at in range(low, high, max(1, CELLS // len(some))):
                        part = mine[at : min(at + max(1, CELLS // len(some)), high)]
                        alike = np.round(self.unit[asked[some]] @ unit[part].T, self.places)
                        met += alike.size
                        x, y = np.nonzero((alike >= self.floor) & (alike >= self.least[asked[some]][:, None]))
                        self.add(asked[some][x], alike[x, y], ids.take(pa.array(rows[part[y]])))
        if self.counted is not None:
            self.counted.add(met)


def nearest(queries: DataFrame, chunks: DataFrame, k: int, keys: list[str] | None = None, overlapping: bool = False, query_id: str = "query_id", chunk_id: str = "chunk_id", places: int = 12, least: float | None = None, met: Accumulator | None = None) -> DataFrame:
    """query_id, chunk_id and cosine similarity (to `places`) of every question's k best chunks of each task, within the columns in keys.

    A stated, counted set of questions meets all chunks in blocks of about QUERY_BLOCK: the vectors of up to BLOCKS_A_SCAN
    blocks are broadcast, batches of chunks are multiplied with each, and a task sends on its k best for each question,
    equal ones by id. Without a vector, with one of zeros, or with a null key a row is like none; with `overlapping`, rows
    without a common non-zero place are left out too. With `least` only rows at least so similar are sent on, and pairs that can't be
    are not compared; `met`, an accumulator, then counts those that are.
    """
    spark = chunks.sparkSession
    group = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    told = lambda df, key: df.where(F.col("embedding").isNotNull() & F.lit(True if not keys else reduce(Column.__and__, [F.col(x).isNotNull() for x in keys]))).select(key, group.alias("group"), F.col("embedding").cast("array<double>").alias("embedding"))
    q, c = told(queries, query_id), told(chunks, chunk_id)
    kinds, names = [q.schema[0].dataType, c.schema[0].dataType], [query_id, chunk_id, "similarity"]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, [*kinds, T.DoubleType()])])

    def held(rows: pa.Table) -> list[_Block]:
        return [_Block(b.column(0), b.column(1).to_numpy(), matrix_of(b.column(2))) for b in rows.combine_chunks().to_batches(max_chunksize=QUERY_BLOCK)]

    scans = max(-(-q.count() // (QUERY_BLOCK * BLOCKS_A_SCAN)), 1)
    found = []
    for part in range(scans):
        rows = q if scans == 1 else q.where(F.pmod(F.xxhash64(query_id), F.lit(scans)) == part)
        rows = rows.toArrow()  # about BLOCKS_A_SCAN blocks
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast(held(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = [_Best(block, k, overlapping, places) if least is None else _Within(block, k, places, least, met) for block in shared.value]
            for batch in batches:
                if batch.num_rows:
                    ids, groups, vectors = batch.column(0), batch.column(1).to_numpy(), matrix_of(batch.column(2))
                    for b in best:
                        b.meet(ids, groups, vectors)
            for b in best:
                yield from b.batches(names)

        found.append(c.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = PER_ARM, keys: list[str] | None = None) -> DataFrame:
    """query_id, chunk_id, similarity and rank: exact cosine over chunks with an embedding, within the columns in keys."""
    return top(nearest(queries, chunks, k, keys), "similarity", k)


def question_terms(queries: DataFrame, stop_words: list[str]) -> DataFrame:
    """query_id and term: distinct stemmed terms of each question without stop words."""
    terms = queries.select("query_id", F.explode(C.query_terms(F.col("question"))).alias("raw")).where(~F.col("raw").isin(stop_words))
    return terms.select("query_id", C.stem(F.col("raw")).alias("term")).distinct()


def raw_terms(queries: DataFrame, stop_words: list[str]) -> DataFrame:
    """Terms of the lexical ablation: words of more than two characters, not split."""
    words = F.filter(F.regexp_extract_all(F.lower("question"), F.lit(r"[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) > 2)
    return queries.select("query_id", F.explode(words).alias("raw")).where(~F.col("raw").isin(stop_words)).select("query_id", C.stem(F.col("raw")).alias("term")).distinct()


def postings(chunks: DataFrame, text: str, stop_words: list[str]) -> DataFrame:
    """chunk_id, term, tf and positions."""
    words = chunks.select("chunk_id", F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))).alias("pos", "raw")).where(~F.col("raw").isin(stop_words))
    words = words.select("chunk_id", C.stem(F.col("raw")).alias("term"), "pos")
    return words.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def lexical_scores(terms: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, chunk_id and score: 0.1 for every occurrence of a term, the cover density of an OR query."""
    return index.join(maybe_broadcast(terms, 200_000), "term").groupBy("query_id", "chunk_id").agg((F.sum("tf") / 10).alias("score"))


def lexical_topk(terms: DataFrame, index: DataFrame, k: int = PER_ARM) -> DataFrame:
    """The k best by lexical_scores() over postings that aren't stored; index_store.topk() reads a stored index."""
    return top(lexical_scores(terms, index), "score", k)


def rrf_fuse(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, rrf, dense_rank and lex_rank of everything that either arm ranks."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "chunk_id", F.col("rank").alias("lex_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + k), F.lit(0.0))
    return d.join(x, ["query_id", "chunk_id"], "full_outer").withColumn("rrf", part("dense_rank") + part("lex_rank"))


def rrf_fuse_arms(arms: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id and rrf over any number of weighted arms."""
    each = [run.select("query_id", "chunk_id", (F.lit(float(w)) / (F.col("rank") + k)).alias("part")) for run, w in arms]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("rrf"))


def hybrid(dense: DataFrame, lexical: DataFrame, chunks: DataFrame, keep: int = KEEP) -> DataFrame:
    """The best of both arms with the chunks' columns, joined last."""
    best = top(rrf_fuse(dense, lexical), "rrf", keep)
    return best.join(chunks.drop("embedding"), "chunk_id")


def path_scope(rows: DataFrame, path_like: str | Column | None) -> DataFrame:
    """Rows whose path holds the text, in any case; % and _ in it are wildcards."""
    if path_like is None:
        return rows
    pattern = F.concat(F.lit("%"), F.lit(path_like) if isinstance(path_like, str) else path_like, F.lit("%"))
    return rows.withColumn("__p", F.lower(pattern)).where("lower(path) LIKE __p").drop("__p")


def rerank_fusion_order(run: DataFrame, keep: int = 8) -> DataFrame:
    return top(run.withColumn("score", F.col("rrf")).drop("rank"), "score", keep)


def rerank_blend(run: DataFrame, relevance: DataFrame | None, keep: int = 8) -> DataFrame:
    """Order by 0.8 relevance and 0.2 of the fused score relative to the query's best; without relevance by the fused score."""
    if relevance is None:
        return rerank_fusion_order(run, keep)
    most = F.greatest(F.max("rrf").over(Window.partitionBy("query_id")), F.lit(1e-9))
    scored = run.withColumn("__most", most).join(relevance, ["query_id", "chunk_id"], "left").withColumn("score", F.lit(0.8) * F.coalesce("relevance", F.lit(0.0)) + F.lit(0.2) * F.col("rrf") / F.col("__most"))
    return top(scored.drop("rank", "__most", "relevance").withColumn("score", F.round("score", 9)), "score", keep)


def search_code(dense: DataFrame, lexical: DataFrame, chunks: DataFrame, k: int = 6) -> DataFrame:
    """The k best hits: a wide net of both arms, reranked, with rounded scores and cut snippets."""
    from corpusmill.operators.text import hits

    wide = hybrid(dense, lexical, chunks, max(3 * k, 18))
    return hits(rerank_fusion_order(wide, k))
