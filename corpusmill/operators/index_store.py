"""An index that is kept: documents by term, blocks of postings with their largest gains, vectors and statistics, written once and read per question.

Documents are dealt to ranges of at most RANGE_DOCS, of like length, as long texts use a word more often. A row of the postings
is one term in one range: the documents with it, and the most that it can add to any of them. No term is one row, however
common it is. A range is made and turned over to terms by the task that reads its documents, so a build shuffles nothing. A search
reads the postings once, for the blocks of its terms, and of these first only the bounds: their sum over a question's terms bounds
every document of a range.
The ranges with the largest bounds are scored, which gives each question a score that its k best reach; of all others only
ranges whose bound isn't below that are read. Nothing that could be among the k best is left out.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import embedding as E

RANGE_DOCS = 128
BLOCK_POSTINGS, BLOCK_ROWS = 1_000_000, 20_000  # postings turned over at once in a task, and rows sent on at once
SMALL_TERMS, SMALL_PAIRS = 200_000, 10_000_000  # asked terms, and pairs of questions and ranges, that are broadcast at most
LENGTH_STEP = 1.3  # lengths of one class differ by less than this factor
K1, B = 1.2, 0.75
SLACK = 1e-9  # what the order of addition may change
WORDS = re.compile(r"[a-z0-9_]+")


def stemmed(word: str) -> str:
    """What the column function stem() gives, of one word."""
    if word.endswith("s"):
        if re.search("[^ea]ies$", word):
            return word[:-3] + "y"
        if re.search("[^aeo]es$", word):
            return word[:-1]
        if re.search("[^us]s$", word):
            return word[:-1]
    return word


class _Stems(dict):
    """Stems of the words that a task has met, none for stop words."""

    def __init__(self, stop_words: list[str]):
        super().__init__(dict.fromkeys(stop_words))

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            stops = [w for w, s in self.items() if s is None]
            self.clear()
            self.update(dict.fromkeys(stops))
        self[word] = s = stemmed(word)
        return s


COUNTS = [T.StructField("dl", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]


def term_counts(chunks: DataFrame, text: str, stop_words: list[str]) -> DataFrame:
    """chunk_id, dl (words that are indexed), terms and tfs of every chunk, in the task that reads it."""
    schema = T.StructType([chunks.schema["chunk_id"], *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = _Stems(stop_words)
        for batch in batches:
            found = []
            for t in batch.column(1):
                counts = Counter(map(stems.__getitem__, WORDS.findall((t.as_py() or "").lower())))
                counts.pop(None, None)
                found.append((sum(counts.values()), list(counts), list(counts.values())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*found) if found else ((), (), ()), (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))))], ["chunk_id", "dl", "terms", "tfs"])

    return chunks.select("chunk_id", F.col(text).alias("__text")).mapInArrow(run, schema)


class _Terms(E.Vocabulary):
    """A vocabulary that also knows the terms of its runs."""

    def __init__(self, dim: int, stop_words: list[str]):
        super().__init__(dim)
        self.stops, self.codes, self.terms = set(stop_words), E.Index(), E.Lists()

    def learn_runs(self) -> None:
        flat, sizes, code = [], [], self.codes.setdefault
        for run in islice(self.runs, self.known_runs, None):
            low = run.lower()
            found = [code(stemmed(w), len(self.codes)) for w in ((low,) if run.isascii() else WORDS.findall(low)) if w not in self.stops]
            flat += found
            sizes.append(len(found))
        self.terms.add(np.array(flat, np.int64), np.array(sizes, np.int64))
        super().learn_runs()

    def counts(self, texts: int, of: np.ndarray, run: np.ndarray, times: np.ndarray) -> list[pa.Array]:
        """dl, terms and tfs of every text."""
        code, size = self.terms.of(run)
        of, times, known = np.repeat(of, size), np.repeat(times, size), max(len(self.codes), 1)
        key, back = np.unique(of * known + code, return_inverse=True)
        tf = np.bincount(back, times, len(key)).astype(np.int32)
        used, place = np.unique(key % known, return_inverse=True)
        names = list(self.codes)
        terms = pa.array([names[i] for i in used.tolist()], pa.string()).take(pa.array(place))
        edges = pa.array(np.searchsorted(key // known, np.arange(texts + 1)).astype(np.int32))
        return [pa.array(np.bincount(of, times, texts).astype(np.int64)), pa.ListArray.from_arrays(edges, terms), pa.ListArray.from_arrays(edges, pa.array(tf))]


def vectors_and_counts(chunks: DataFrame, text: str, dim: int, stop_words: list[str]) -> DataFrame:
    """What bucket_vectors() and term_counts() give, of texts taken apart once."""

    def told(held: _Terms, part: list[str]) -> list[pa.Array]:
        read = held.read(part)
        return [E.bucket_lists(held.sums_of(len(part), *read)), *held.counts(len(part), *read[2:])]

    return E.embedded(chunks, "chunk_id", text, [E.BUCKETS, *COUNTS], lambda: _Terms(dim, stop_words), told, dim)


def postings_schema(kind: T.DataType) -> T.StructType:
    """The columns of the postings of documents with ids of that type."""
    docs = T.ArrayType(T.StructType([T.StructField("chunk_id", kind), T.StructField("tf", T.IntegerType()), T.StructField("dl", T.LongType())]))
    return T.StructType([T.StructField(*x) for x in {"term": T.StringType(), "range": T.LongType(), "docs": docs, "n": T.LongType(), "most_tf": T.IntegerType(), "most_gain": T.DoubleType()}.items()])


def gains(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """What a term of an idf of one adds by BM25."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def turned_over(docs: pa.Table, ranges: np.ndarray, avgdl: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The postings of documents (chunk_id, dl, terms, tfs) that lie in these ranges: a row for each term of a range."""
    order = pc.sort_indices(pa.table({"r": ranges, "i": docs["chunk_id"]}), [("r", "ascending"), ("i", "ascending")])
    docs, ranges = docs.take(order).combine_chunks(), ranges[order.to_numpy()]
    ids, dl, terms, tf = docs["chunk_id"].combine_chunks(), docs["dl"].to_numpy(), docs["terms"].combine_chunks(), docs["tfs"].combine_chunks().flatten()
    of = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
    coded = terms.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    _, place = np.unique(ranges, return_inverse=True)
    key = place[of] * len(coded.dictionary) + code
    by = np.argsort(key, kind="stable")  # documents of a term stay in the order of their ids
    key, of, code, tf = key[by], of[by], code[by], tf.take(pa.array(by))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    edges, count = np.concatenate([first, [len(key)]]), tf.to_numpy()
    told = pa.StructArray.from_arrays([ids.take(pa.array(of)), tf, pa.array(dl[of])], ["chunk_id", "tf", "dl"])
    gain = np.maximum.reduceat(gains(count.astype(float), dl[of], avgdl), first)
    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), told)
    cols = [coded.dictionary.take(pa.array(code[first])), pa.array(ranges[of[first]]), lists, pa.array(np.diff(edges)), pa.array(np.maximum.reduceat(count, first)), pa.array(gain)]
    for low in range(0, len(first), BLOCK_ROWS):
        yield pa.RecordBatch.from_arrays([c.slice(low, BLOCK_ROWS) for c in cols], names)


def blocks_of(docs: DataFrame, avgdl: float, range_docs: int = RANGE_DOCS) -> DataFrame:
    """The postings of docs. A task keeps documents by class of length until a class fills a range; at its end the rest are ranges too."""
    schema = postings_schema(docs.schema["chunk_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None

        def parts() -> Iterator[pa.Table]:
            for batch in batches:
                size = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)) // BLOCK_POSTINGS if batch.num_rows else np.zeros(0)
                for x in np.unique(size):
                    low, high = np.searchsorted(size, x), np.searchsorted(size, x, side="right")
                    yield pa.Table.from_batches([batch.slice(low, high - low)])
            yield None

        for part in parts():
            last = part is None
            if not last:
                held = pa.concat_tables([held, part]) if held is not None else part
            if held is None or not held.num_rows:
                continue
            of = np.floor(np.log(held["dl"].to_numpy()) / np.log(LENGTH_STEP)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            kind, nth = of[order], np.arange(len(of)) - np.searchsorted(of[order], of[order])
            many = np.searchsorted(kind, kind, side="right") - np.searchsorted(kind, kind)
            full = (nth < many // range_docs * range_docs) | last
            if not full.any():
                continue
            _, at = np.unique(kind[full] * (1 << 32) + nth[full] // range_docs, return_inverse=True)
            yield from turned_over(held.take(pa.array(order[full])), number + at, avgdl, schema.names)
            number += int(at.max()) + 1
            held = held.take(pa.array(order[~full])).combine_chunks()

    return docs.select("chunk_id", "dl", "terms", "tfs").mapInArrow(run, schema)


class Index:
    """The tables of a stored index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.stats = spark.read.parquet(f"{path}/stats").first()  # one row
        self.postings_schema = postings_schema(self.documents.schema["chunk_id"].dataType)
        self.postings = spark.read.schema(self.postings_schema).parquet(f"{path}/postings")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents").select("chunk_id", "embedding")

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents").drop("embedding")


def build(chunks: DataFrame, text: str, path: str, stop_words: list[str], dim: int = 0, range_docs: int = RANGE_DOCS) -> Index:
    """Writes an index of chunks (chunk_id and text) at path; with dim also their hashed embeddings."""
    spark = chunks.sparkSession
    read = vectors_and_counts(chunks, text, dim, stop_words) if dim else term_counts(chunks, text, stop_words)
    read.write.parquet(f"{path}/documents")
    docs = spark.read.parquet(f"{path}/documents").where(F.col("dl") > 0)
    docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).write.parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats").first()
    blocks_of(docs, float(stats["avgdl"]), range_docs).write.parquet(f"{path}/postings")
    return Index(spark, path)


def _small(terms: DataFrame) -> bool:
    """Whether asked terms are few enough to be broadcast, by their count."""
    return terms.limit(SMALL_TERMS + 1).count() <= SMALL_TERMS


def _asked_blocks(terms: DataFrame, index: Index, small: bool) -> DataFrame:
    """The blocks of all asked terms: found in one reading of the postings and written, as a search reads them several times."""
    asked = terms.select("term").distinct()
    at = f"{index.path}-asked/{uuid.uuid4().hex}"
    index.postings.join(F.broadcast(asked) if small else asked, "term", "left_semi").select(*index.postings_schema.names).write.parquet(at)
    return index.spark.read.schema(index.postings_schema).parquet(at)


def _told(terms: DataFrame, blocks: DataFrame, index: Index, bm25: bool, small: bool) -> tuple[DataFrame, DataFrame]:
    """query_id, term and idf of all asked terms that the index has, and the most that each adds in each range, by the asked terms' blocks."""
    few = F.broadcast if small else lambda df: df
    heads = blocks.select("term", "range", "n", "most_tf", "most_gain")
    if bm25:
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        asked = few(terms).join(df, "term").select("query_id", "term", F.log((F.lit(index.stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
        most = F.col("most_gain") * F.col("idf")
    else:
        asked, most = terms.select("query_id", "term", F.lit(1.0).alias("idf")), F.col("most_tf").cast("double")
    return asked, heads.join(few(asked), "term").groupBy("query_id", "range").agg(F.sum(most).alias("bound"), F.sum("n").alias("postings"), F.max("n").alias("docs"), F.count(F.lit(1)).alias("blocks"))


def _scored(asked: DataFrame, ranges: DataFrame | None, postings: DataFrame, index: Index, bm25: bool, within: DataFrame | None, small: bool) -> DataFrame:
    """query_id, chunk_id and score by these postings, over the ranges named for each question, or over all.

    Where questions and ranges are few by their counts, blocks meet them where they are read, and what a task's blocks add to
    a document leaves it as one row.
    """
    blocks = postings.join(F.broadcast(asked) if small else asked, "term")
    if ranges is not None:
        if small:
            readers = ranges.groupBy("range").agg(F.collect_list("query_id").alias("readers"))
            blocks = blocks.join(F.broadcast(readers), "range").where(F.array_contains("readers", F.col("query_id")))
        else:
            blocks = postings.join(asked.join(ranges, "query_id"), ["term", "range"])
    rows = blocks.select("query_id", "idf", F.inline("docs"))
    if within is not None:
        rows = rows.join(within.select("chunk_id"), "chunk_id", "left_semi")
    if not bm25:
        return rows.groupBy("query_id", "chunk_id").agg((F.sum("tf") / 10).alias("score"))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(index.stats["avgdl"]))))
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("idf") * gain), 9).alias("score"))


def scores(terms: DataFrame, index: Index) -> DataFrame:
    """query_id, chunk_id and score, 0.1 for every occurrence of a term, of all documents with a term of the question."""
    return _scored(terms.select("query_id", "term", F.lit(1.0).alias("idf")), None, index.postings, index, False, None, _small(terms))


def chosen_ranges(terms: DataFrame, index: Index, k: int, bm25: bool, within: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The asked terms, their blocks, and all ranges with their bound, what it must reach, and whether they are read."""
    small = _small(terms)
    blocks = _asked_blocks(terms, index, small)
    asked, bounds = _told(terms, blocks, index, bm25, small)
    # Ranges by falling bound until they hold k documents with a term for sure.
    before = F.sum("docs").over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range").rowsBetween(Window.unboundedPreceding, -1))
    first = bounds.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < 2 * k).select("query_id", "range")
    probed = _scored(asked, first, blocks, index, bm25, within, small)
    best = probed.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("nth") == k).select("query_id", (F.col("score") * (1.0 if bm25 else 10.0)).alias("least"))
    return asked, blocks, bounds.join(best, "query_id", "left").withColumn("read", F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)


def topk(terms: DataFrame, index: Index, k: int, bm25: bool = False, within: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score and rank of the k best documents of every question, ties by id."""
    asked, blocks, ranges = chosen_ranges(terms, index, k, bm25, within)
    few = _small(terms) and terms.select("query_id").distinct().count() * (index.stats["n"] // RANGE_DOCS + 1) <= SMALL_PAIRS
    found = _scored(asked, ranges.where("read").select("query_id", "range"), blocks, index, bm25, within, few)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def skipped(terms: DataFrame, index: Index, k: int, bm25: bool = False) -> float:
    """The share of the blocks with a question's terms that its search doesn't read."""
    _, _, ranges = chosen_ranges(terms, index, k, bm25)
    read, every = ranges.agg(F.sum(F.when(F.col("read"), F.col("blocks")).otherwise(0)), F.sum("blocks")).first()
    return 1 - (read or 0) / every if every else 0.0
