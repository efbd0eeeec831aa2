"""The engine's input tables, made from the star-schema and text tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.index_store import Index, build
from corpusmill.sources.corpus import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df  # much work for each of few rows


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the place that the cluster shares; a temporary one only where none is named and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path, for what is read more than once."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stored indexes of this application, by what they were made of.
_indexes: dict[tuple, object] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))


def kept(spark: SparkSession, sf_dir: str, name: str, what: tuple, make: Callable[[str], object]) -> object:
    """What make() writes and returns for a table: made at first use and again when the table's files change."""
    key = (spark.sparkContext.applicationId, what, state_of(spark, f"{sf_dir}/{name}.parquet"))
    if key not in _indexes:
        _indexes[key] = make(work_dir(spark, "-".join(map(str, what))))
    return _indexes[key]


def stored_index(spark: SparkSession, sf_dir: str, dim: int, stop_words: list[str]) -> Index:
    """The index of the documents: built at first use and again when their files change, read by every search."""
    chunks = lambda: table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return kept(spark, sf_dir, "documents", ("index", dim), lambda at: build(chunks(), "text", at, stop_words, dim))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path, content and bytes: one file per document and per page."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    end = F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt")
    one = docs.select(F.col("source").alias("repo_id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"), F.col("text").alias("content"))
    two = pages.select(F.lit("pages").alias("repo_id"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return one.unionByName(two).withColumn("bytes", F.octet_length("content").cast("long"))


TEXT_FILES = """text_files AS (
  SELECT source AS repo_id, lang || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS path, text AS content, CAST(strlen(text) AS BIGINT) AS bytes FROM documents
  UNION ALL SELECT 'pages', page_id || '.html', html, CAST(strlen(html) AS BIGINT) FROM pages)"""


def _joined(df: DataFrame, group: list, order: list, line: F.Column) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    # A group's columns move, and its lines are made and collected where they end up; collected before, arrays of lines would move.
    return df.repartition(*group).groupBy(*group).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("body"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, path and content of source files told from parts, line items, nations and orders.

    A file holds the rows of a range of keys (or of one supplier, who has some 600 line items at any scale), so there are
    more files, not longer ones, where there are more rows.
    """
    part = table(spark, sf_dir, "part")
    block = F.concat(F.lit("def part_"), F.col("p_partkey").cast("string"), F.lit("(x):\n    # "), "p_name", F.lit(" of type "), "p_type", F.lit("\n    return x * "), F.col("p_size").cast("string"), F.lit("\n"))
    part = part.withColumn("bin", F.floor(F.col("p_partkey") / 2000))
    python = _joined(part, ["p_brand", "bin"], ["p_partkey"], block).select(F.lit("acme/parts").alias("repo_id"), F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit("_"), F.col("bin").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("import math\n\n"), "body").alias("content"))
    items = table(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("  line"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(" = "), F.col("l_quantity").cast("int").cast("string"), F.lit(";"))
    key = F.col("l_suppkey").cast("string")
    scripts = _joined(items, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], line).select(F.lit("acme/suppliers").alias("repo_id"), F.concat(F.lit("lib/supplier_"), key, F.lit(".ts")).alias("path"), F.concat(F.lit("export class Supplier"), key, F.lit(" {\n"), "body", F.lit("\n}")).alias("content"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    section = F.concat(F.lit("## "), "n_name", F.lit("\nOne of the nations of this region, number "), F.col("n_nationkey").cast("string"), F.lit(".\n"))
    notes = _joined(nations, ["r_name"], ["n_nationkey"], section).select(F.lit("acme/docs").alias("repo_id"), F.concat(F.lit("docs/"), F.lower("r_name"), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "r_name", F.lit("\nWhat there is to know.\n"), "body").alias("content"))
    orders = table(spark, sf_dir, "orders").withColumn("bin", F.floor(F.col("o_orderkey") / 4000))
    row = F.concat(F.lit('{"order": '), F.col("o_orderkey").cast("string"), F.lit(', "status": "'), "o_orderstatus", F.lit('"}'))
    data = _joined(orders, ["bin"], ["o_orderkey"], row).select(F.lit("acme/docs").alias("repo_id"), F.concat(F.lit("data/orders_"), F.col("bin").cast("string"), F.lit(".json")).alias("path"), F.col("body").alias("content"))
    return python.unionByName(scripts).unionByName(notes).unionByName(data)


CODE_FILES = """code_files AS (
  SELECT 'acme/parts' AS repo_id, 'src/' || lower(replace(p_brand, '#', '_')) || '_' || (p_partkey // 2000) || '.py' AS path, 'import math' || chr(10) || chr(10) || string_agg('def part_' || p_partkey || '(x):' || chr(10) || '    # ' || p_name || ' of type ' || p_type || chr(10) || '    return x * ' || p_size || chr(10), chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY p_brand, p_partkey // 2000
  UNION ALL SELECT 'acme/suppliers', 'lib/supplier_' || l_suppkey || '.ts', 'export class Supplier' || l_suppkey || ' {' || chr(10) || string_agg('  line' || l_orderkey || '_' || l_linenumber || ' = ' || CAST(floor(l_quantity) AS INTEGER) || ';', chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) || chr(10) || '}' FROM lineitem GROUP BY l_suppkey
  UNION ALL SELECT 'acme/docs', 'docs/' || lower(r_name) || '.md', '# ' || r_name || chr(10) || 'What there is to know.' || chr(10) || string_agg('## ' || n_name || chr(10) || 'One of the nations of this region, number ' || n_nationkey || '.' || chr(10), chr(10) ORDER BY n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
  UNION ALL SELECT 'acme/docs', 'data/orders_' || (o_orderkey // 4000) || '.json', string_agg('{"order": ' || o_orderkey || ', "status": "' || o_orderstatus || '"}', chr(10) ORDER BY o_orderkey) FROM orders GROUP BY o_orderkey // 4000)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and question: the benchmark items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query log told from the events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 8).alias("repo_id"), F.concat(F.lit("question "), "props").alias("question"), F.col("event_type").alias("mode"), F.round(F.col("value") * 100).cast("long").alias("latency_ms"),
        F.when(F.col("event_type") == "purchase", F.col("value") / 1000).otherwise(F.lit(0.0)).alias("cost_usd"), (F.col("event_type") == "view").alias("cache_hit"), (F.col("event_type") == "error").alias("injection"), F.col("ts").alias("created_at"),
    )


QUERY_LOG = """query_log AS (SELECT event_id AS id, user_id % 8 AS repo_id, 'question ' || props AS question, event_type AS mode, CAST(round(value * 100) AS BIGINT) AS latency_ms,
  CASE WHEN event_type = 'purchase' THEN value / 1000 ELSE 0.0 END AS cost_usd, event_type = 'view' AS cache_hit, event_type = 'error' AS injection, ts AS created_at FROM events)"""
