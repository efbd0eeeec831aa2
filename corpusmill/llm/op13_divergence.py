"""Divergence of the sources of a language, priced over hash-consed segment trees (operator 13).

A task finds the terms of its texts on their bytes and sums them by language, source and term before anything moves; only
such sums are shuffled. A term is kept where at least `least` documents of its language have it. The kept terms of a language
are dealt to blocks of terms met about as often, so most blocks of rare terms are nearly all zeros.

In a block every group (a source of the language) has a segment tree over the block's term ids, with counts as leaves.
Nodes are hash-consed level by level: a node is known by its two children, so equal subtrees of any groups are one node,
and groups with the same counts share their root. Two trees are walked at the same time from the pair of their roots; what
is carried on is the distinct pairs of nodes with the number of places where each is met, so a pair of equal nodes is
expanded once, and at the leaves each pair of counts is priced once and multiplied. Groups that share two roots share their
walk, and all walks of a block go down level by level together. Blocks give a row for each pair of groups, summed by Spark.

All numbers are whole. A count of over nine milliards is multiplied in Python's own integers or in decimals.

Defined cases: a null language, source or text is an empty string; equal rows count each; a group without kept terms, or
of a language without any, is there with values of 0 and no terms; an empty table gives no rows; other columns, whatever
their names, are not read. Ties go by the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .spaces import documents, materialize, parts, small_batches

SCALE = 1_000_000_000
LEAST, TOP = 3, 200
BLOCK_TERMS, BLOCK_CELLS, WALK_CELLS = 4096, 1 << 22, 1 << 21
HELD_ROWS = 400_000  # sums that a task holds before it sends them on

# The bytes of [^\x00-\x40\x5B-\x60\x7B-\x7F] in UTF-8.
TERM = np.ones(256, bool)
TERM[:0x41] = TERM[0x5B:0x61] = TERM[0x7B:0x80] = False


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents), summed within tasks only."""
    names = ["lang", "source", "term", "n", "df"]

    def close(held: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(held).group_by(names[:3]).aggregate([("n", "sum"), ("df", "sum")])
        return t.select([*names[:3], "n_sum", "df_sum"]).rename_columns(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            groups = [c.fill_null("") for c in batch.columns[:2]]
            buf, off = tv.text_views(batch.column(2))
            for i, j in tv.chunks(off):
                t = _chunk_counts(tv.lower_ascii(buf[off[i] : off[j]]), off[i : j + 1] - off[i], *(c.slice(i, j - i) for c in groups))
                held.append(t.rename_columns(names))
                rows += t.num_rows
                if rows > HELD_ROWS:
                    held = [close(held)]
                    rows = held[0].num_rows
                    if rows > HELD_ROWS // 2:
                        yield from held.pop().to_batches(max_chunksize=20_000)
                        rows = 0
        if held:
            yield from close(held).to_batches(max_chunksize=20_000)

    return small_batches(docs.select(F.col(lang_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col).alias("text"))).mapInArrow(run, "lang string, source string, term string, n long, df long")


def _chunk_counts(low: np.ndarray, off: np.ndarray, lang: pa.Array, source: pa.Array) -> pa.Table:
    solid = TERM[low]
    starts, ends, first = tv.runs(solid, off)
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    spelled = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(low[solid])).dictionary_encode()
    kinds = max(len(spelled.dictionary), 1)
    # Documents are told by the row, groups by the pair of language and source.
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    key, n = np.unique(doc * kinds + spelled.indices.to_numpy(zero_copy_only=False), return_counts=True)
    of = [c.dictionary_encode() for c in (lang, source)]
    group = of[0].indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(of[1].dictionary), 1) + of[1].indices.to_numpy(zero_copy_only=False)
    (g, t), (n, df) = tv.pair_counts(group[key // kinds], key % kinds, weights=[n, np.ones(len(key), np.int64)])
    width = max(len(of[1].dictionary), 1)
    take = lambda values, at: values.take(pa.array(at))
    return pa.table([take(of[0].dictionary, g // width), take(of[1].dictionary, g % width), take(spelled.dictionary, t), pa.array(n), pa.array(df)], ["a", "b", "c", "d", "e"])


class Forest:
    """Segment trees over the columns of a matrix of counts, one per row, with equal subtrees shared."""

    def __init__(self, counts: np.ndarray):
        n, terms = counts.shape
        size = 1
        while size < terms:
            size *= 2
        padded = np.full((n, size), -1, np.int64)  # -1: no term there
        padded[:, :terms] = counts
        self.leaves, at = np.unique(padded, return_inverse=True)
        at = at.reshape(padded.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves' parents up
        width = len(self.leaves)
        while at.shape[1] > 1:
            nodes, back = np.unique(at[:, 0::2] * width + at[:, 1::2], return_inverse=True)
            self.children.append((nodes // width, nodes % width))
            at, width = back.reshape(n, -1), len(nodes)
        self.roots = at[:, 0]

    def meet(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For pairs of roots, walked at the same time: the edges of each pair's slice, and the distinct pairs of counts below it with the number of terms at which they meet."""
        pair, left, right, times = np.arange(len(a)), a, b, np.ones(len(a), np.int64)
        for low, high in reversed(self.children):
            width = int(max(low.max(), high.max())) + 1
            left, right, pair, times = np.concatenate([low[left], high[left]]), np.concatenate([low[right], high[right]]), np.concatenate([pair, pair]), np.concatenate([times, times])
            key = (pair * width + left) * width + right
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.add.reduceat(times[order], at)
            pair, left, right = key[at] // (width * width), key[at] // width % width, key[at] % width
        real = self.leaves[left] >= 0
        pair = pair[real]
        return np.searchsorted(pair, np.arange(len(a) + 1)), self.leaves[left[real]], self.leaves[right[real]], times[real]


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly."""
    if len(counts) and int(counts.max()) >= (1 << 63) // SCALE - 1:
        return np.array([1 + SCALE * (int(c) + 1) // (total + terms) for c in counts], np.int64)
    return 1 + SCALE * (counts + 1) // (total + terms)


def _prices(block: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """lang, source, item and value of all ordered pairs of a language's groups over one block of terms."""
    groups = groups.sort_values("source", ignore_index=True)
    n, terms = len(groups), int(block["idx"].max())
    place = {s: k for k, s in enumerate(groups["source"])}
    row = block["source"].map(place).to_numpy()
    active, mine = np.unique(row, return_inverse=True)
    counts = np.zeros((len(active) + 1, terms), np.int64)  # the last row: groups with none of these terms
    counts[mine, block["idx"].to_numpy() - 1] = block["n"].to_numpy()
    forest = Forest(counts)
    root = np.full(n, forest.roots[-1])
    root[active] = forest.roots[:-1]
    total, kept = [int(x) for x in groups["total"]], int(groups["terms"].iloc[0])
    value = np.zeros((n, n), np.int64)
    a, b = np.triu_indices(n, 1)
    low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
    (low_root, high_root), _ = tv.pair_counts(low, high, weights=[])
    width = int(root.max()) + 1
    walk = np.searchsorted(low_root * width + high_root, low * width + high)
    order, step = np.argsort(walk, kind="stable"), max(WALK_CELLS // terms, 1)
    for first in range(0, len(low_root), step):  # so many walks at once that their pairs of leaves are bounded
        edge, x, y, times = forest.meet(low_root[first : first + step], high_root[first : first + step])
        for t in order[np.searchsorted(walk[order], first) : np.searchsorted(walk[order], first + step)]:
            i, j, k = a[t], b[t], walk[t] - first
            here = slice(edge[k], edge[k + 1])
            c, d = (y[here], x[here]) if root[i] > root[j] else (x[here], y[here])
            p, q = shares(c, total[i], kept), shares(d, total[j], kept)
            far = (p - q) * (p - q)
            value[i, j], value[j, i] = (times[here] * (far // q)).sum(), (times[here] * (far // p)).sum()
    a, b = np.nonzero(~np.eye(n, dtype=bool))
    names = groups["source"].to_numpy()
    return pd.DataFrame({"lang": block["lang"].iloc[0], "source": names[a], "item": names[b], "value": value[a, b]})


def _share(count: str, total: str) -> str:
    return f"(1 + (CAST({count} + 1 AS DECIMAL(20,0)) * {SCALE}BD) div CAST({total} + terms AS DECIMAL(20,0)))"


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: the price of each other source, and the terms that a group has more of than its language."""
    counts = materialize(term_counts(docs, lang_col, source_col, text_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "divergence-counts")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("c"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df")
    terms = materialize(terms.withColumn("level", F.floor(F.log2("c")).cast("int")), "divergence-terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("c").alias("lang_total"))
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    # Terms of one level are dealt by hash to as many blocks as keep the cells of a block (sources times terms) bounded.
    most = F.greatest(F.least(F.floor(F.lit(BLOCK_CELLS) / F.col("sources")), F.lit(BLOCK_TERMS)), F.lit(1))
    levels = terms.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("many")).join(sources, "lang").select("lang", "level", F.ceil(F.col("many") / most).alias("parts"))
    placed = terms.join(levels, ["lang", "level"]).withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))
    placed = placed.withColumn("idx", F.row_number().over(Window.partitionBy(F.struct("lang", "level", "part")).orderBy(F.desc("c"), "term"))).select("lang", "term", "c", "level", "part", "idx")
    entries = materialize(counts.drop("df").join(placed, ["lang", "term"]), "divergence-entries")
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialize(groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")), "divergence-groups")
    block = ["lang", "level", "part"]
    spark = docs.sparkSession
    # Much work for each of few rows: the blocks are dealt to all partitions, whatever their size in bytes.
    dealt = lambda df, names: df.repartition(parts(spark), *names).groupBy(*names)
    each = entries.select(*block).distinct().join(groups.select("lang", "source", "total", "terms"), "lang").select(*(F.col(c).alias(f"of_{c}") for c in block), "source", "total", "terms")
    priced = dealt(entries.select(*block, "source", "idx", "n"), block).cogroup(dealt(each, [f"of_{c}" for c in block])).applyInPandas(_prices, "lang string, source string, item string, value long")
    # A language without kept terms has no block: its pairs are worth 0.
    bare = groups.where(F.col("terms") == 0).select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item")).withColumn("value", F.lit(0).cast("long"))
    pairs = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(none)
    more = entries.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), F.expr(_share("n", "total")).alias("p"), F.expr(_share("c", "lang_total")).alias("q"))
    more = more.where(F.col("p") > F.col("q")).select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS terms, sum(c)::BIGINT AS lang_total FROM kept GROUP BY lang),
g0 AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT n.lang, n.source, n.term, n.n, k.c FROM n JOIN kept k ON k.lang = n.lang AND k.term = n.term),
t AS (SELECT lang, source, sum(n)::BIGINT AS total FROM e GROUP BY lang, source),
g AS (SELECT g0.lang, g0.source, coalesce(total, 0) AS total, coalesce(terms, 0) AS terms, coalesce(lang_total, 0) AS lang_total FROM g0 LEFT JOIN v ON v.lang = g0.lang LEFT JOIN t ON t.lang = g0.lang AND t.source = g0.source),
full_ AS (SELECT g.lang, g.source, k.term, CAST(1 + (1000000000::HUGEINT * (coalesce(e.n, 0) + 1)) // (g.total + g.terms) AS BIGINT) AS p FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN e ON e.lang = g.lang AND e.source = g.source AND e.term = k.term),
prices AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN prices p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
pq AS (SELECT e.lang, e.source, e.term AS item, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (total + terms) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (c + 1)) // (lang_total + terms) AS BIGINT) AS q FROM e JOIN g ON g.lang = e.lang AND g.source = e.source),
terms_ AS (SELECT lang, source, item, ((p - q) * (p - q)) // q AS value FROM pq WHERE p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms_) WHERE rank <= 200
"""
