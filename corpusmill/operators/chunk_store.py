"""Tables of chunks and of repositories that are written in place, and indexing in passes that stop and go on.

Chunks lie in a folder for each repository and part of its hashes, repositories in one for each part of their ids. Appending
adds files; pruning and upserting rewrite only the folders that hold a changed row, all at once when the job commits, and
files of all other folders stay as they are.

Texts move once, when staged() brings the chunks of a folder together. From then on joins and sorts carry keys and the rows'
numbers, and what they pick is a bit for each row, by which the tasks that read the texts take or leave them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import embedding as E
from corpusmill.operators.indexing import insert_chunks, upsert_repos

PARTS = 4
ROUND = 4  # a round has so many times the passes of the one before
KEY = ["repo_id", "path", "start_line", "content_hash"]
TEXTS = {"compression": "zstd", "parquet.block.size": 16 << 20}  # a file is read by as many tasks as it has blocks


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")


def staged(chunks: DataFrame, path: str, parts: int = PARTS) -> DataFrame:
    """Chunks as a table at path, those of a folder of the store together, with a number of each, row."""
    placed = chunks.select("*", _part("content_hash", parts)).hint("rebalance", F.col("repo_id"), F.col("part"))
    numbered = placed.drop("part").withColumn("row", F.monotonically_increasing_id())
    numbered.write.options(**TEXTS).parquet(path)
    return chunks.sparkSession.read.schema(numbered.schema).parquet(path)


def bitmaps(rows: DataFrame, number: str, by: list[str]) -> DataFrame:
    """The numbers of rows as bits: by, bucket and bits, 4 KB for up to 32,768 numbers."""
    return rows.groupBy(*by, F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def with_bit(rows: DataFrame, number: str, bits: DataFrame, by: list[str]) -> DataFrame:
    """rows and whether bitmaps() of them has each one's number, as the column bit; a broadcast of a bit for each row."""
    at = F.bitmap_bit_position(number).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, at.bitwiseAND(7)) == 1, F.lit(False))
    return rows.withColumn("bucket", F.bitmap_bucket_number(number)).join(F.broadcast(bits), [*by, "bucket"], "left").withColumn("bit", bit).drop("bucket", "bits")


class _Table:
    """Rows in folders by the columns in `folders`, of which the last, part, is told by a hash of `key`."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, folders: list[str], key: str, parts: int = PARTS):
        self.spark, self.path, self.folders, self.key, self.parts = spark, path, folders, key, parts
        self.columns = [f.name for f in schema.fields]
        inner = [f for f in schema.fields if f.name not in folders]
        self.schema = T.StructType([*inner, *(schema[c] if c in self.columns else T.StructField(c, T.IntegerType()) for c in folders)])

    def rows(self) -> DataFrame:
        """All rows with their part."""
        return self.spark.read.schema(self.schema).parquet(self.path) if _exists(self.spark, self.path) else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self.rows().select(*self.columns)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns, _part(self.key, self.parts))

    def _write(self, rows: DataFrame, mode: str, together: bool) -> None:
        if not together:  # a folder's rows come together, and Spark splits a folder that holds much more than others
            rows = rows.hint("rebalance", *map(F.col, self.folders))
        rows.write.mode(mode).options(partitionOverwriteMode="dynamic", **TEXTS).partitionBy(*self.folders).parquet(self.path)

    def append(self, rows: DataFrame, together: bool = False) -> None:
        """Adds rows; those that are together by folder, as staged() brings them, are written where they are read."""
        self._write(self._placed(rows), "append", together)

    def rewrite(self, rows: DataFrame, touched: DataFrame, together: bool = False) -> None:
        """Puts rows, with their part if they are together, in place of all that the touched folders hold; those that get no row go."""
        rows, kept = rows if together else self._placed(rows), touched.select(*self.folders).distinct()
        filled = rows.select(*self.folders).distinct()
        empty = [tuple(r) for r in kept.join(filled, self.folders, "left_anti").collect()]  # folders, which the driver lists anyway
        self._write(rows, "overwrite", together)
        for folder in empty:
            self.drop(folder)

    def drop(self, folder: tuple) -> None:
        """Deletes a folder, or with fewer values than folders all below it."""
        jvm, at = self.spark._jvm, self.path
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for name, value in zip(self.folders, folder):
            at += f"/{name}={escape(str(value)) if value is not None else '__HIVE_DEFAULT_PARTITION__'}"
        gone = jvm.org.apache.hadoop.fs.Path(at)
        gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)


CHUNK = T.StructType([T.StructField(n, t) for n, t in (("repo_id", T.StringType()), ("path", T.StringType()), ("start_line", T.LongType()), ("content_hash", T.StringType()), ("content", T.StringType()), ("embed_model", T.StringType()), ("embedding", T.ArrayType(T.FloatType())))])


class ChunkStore(_Table):
    """Chunks by repository and hash."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = CHUNK, parts: int = PARTS):
        super().__init__(spark, path, schema, ["repo_id", "part"], "content_hash", parts)

    def insert(self, rows: DataFrame, order: list[str]) -> None:
        """Appends what insert_chunks() tells to be new."""
        self.append(insert_chunks(self.read(), rows, order))

    def delete(self, repos: DataFrame) -> None:
        """Deletes the folders of the repositories in repos (column repo_id)."""
        for r in repos.select("repo_id").distinct().collect():  # names of folders
            self.drop((r["repo_id"],))

    def prune(self, stale: Callable[[DataFrame], DataFrame], at: str) -> None:
        """Drops the rows that stale() picks out of all; where they lie is written at `at`."""
        if not _exists(self.spark, self.path):
            return
        rows = self.rows().select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"))
        gone = bitmaps(stale(rows), "nth", [*self.folders, "file"])
        gone.write.parquet(at)
        gone = self.spark.read.schema(gone.schema).parquet(at)
        touched = gone.select(*self.folders).distinct()
        repos = [r["repo_id"] for r in touched.select("repo_id").distinct().collect()]  # names of folders
        if not repos:
            return
        held = rows.where(F.col("repo_id").isin(repos)).join(F.broadcast(touched), self.folders, "left_semi")
        rest = with_bit(held, "nth", gone.drop(*self.folders), ["file"]).where(~F.col("bit"))
        self.rewrite(rest.select(*self.schema.names), touched, together=True)  # rows stay in the task that reads them and in their folder


class RepoStore(_Table):
    """Repositories by id."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, parts: int = 16):
        super().__init__(spark, path, schema, ["part"], "id", parts)

    def upsert(self, new: DataFrame) -> None:
        """Inserts or updates the repositories in new, rewriting only their parts."""
        touched = new.select(F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int").alias("part")).distinct()
        held = self.rows().join(F.broadcast(touched), "part", "left_semi").select(*self.columns)  # at most `parts` rows are broadcast
        self.rewrite(upsert_repos(held, new), touched)


class Plan(NamedTuple):
    """What a pass takes: bitmaps of its rows' numbers; repo_id and new, the new chunks of every repository that sent any; how many of each come before."""

    picked: DataFrame
    counts: DataFrame
    before: int


def _new(store: ChunkStore, incoming: DataFrame, model: str, at: str) -> tuple[DataFrame, DataFrame]:
    """repo_id, row and nth of the new chunks, from 1 in the order in which a repository's passes take them; and the counts of a plan."""
    spark = store.spark
    new = insert_chunks(store.read().where(F.col("embed_model").eqNullSafe(F.lit(model))), incoming.select(*KEY, "row"), ["path", "start_line"])
    # All tasks sort together, as one repository may have most rows; where its rows of a task begin is told from their numbers.
    new.orderBy(*KEY).select("repo_id", "row", F.monotonically_increasing_id().alias("seq")).write.parquet(f"{at}/sorted")
    new = spark.read.schema("repo_id string, row long, seq long").parquet(f"{at}/sorted").withColumn("task", F.shiftright("seq", 33))
    runs = new.groupBy("repo_id", "task").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    before = F.sum("n").over(Window.partitionBy("repo_id").orderBy("task")) - F.col("n")
    start = runs.select(F.col("repo_id").alias("repo"), F.col("task").alias("in"), "first", before.alias("before"))
    nth = new.join(start, F.col("repo_id").eqNullSafe(F.col("repo")) & (F.col("task") == F.col("in"))).select("repo_id", "row", (F.col("before") + F.col("seq") - F.col("first") + 1).alias("nth"))
    counts = incoming.select("repo_id", F.lit(0).cast("long").alias("n")).unionByName(runs.select("repo_id", "n")).groupBy("repo_id").agg(F.sum("n").alias("new"))
    counts.write.parquet(f"{at}/counts")
    return nth, spark.read.schema("repo_id string, new long").parquet(f"{at}/counts")


def _numbered(incoming: DataFrame, at: str) -> DataFrame:
    return incoming if "row" in incoming.columns else staged(incoming, at)


def index_pass(store: ChunkStore, incoming: DataFrame, model: str, budget: int, dim: int, at: str, plan: Plan | None = None) -> DataFrame:
    """Embeds at most `budget` new chunks of every repository that sent any, appends them, and prunes those that are done.

    A chunk is new where the store has no row of its repository and hash under this model, so a pass goes on where the last
    one stopped, and after a change of model old rows stay until all new vectors are there. A repository that is done loses
    what it didn't send and what another model made; one that sent nothing stays as it is. Gives repo_id, embedded,
    remaining and status, from a table at `at`. incoming comes from staged(), or is staged beside `at`; a pass without a plan
    looks for itself what is new.
    """
    incoming = _numbered(incoming, f"{at}-sent")
    if plan is None:
        new, counts = _new(store, incoming, model, f"{at}-new")
        plan = Plan(bitmaps(new.where(F.col("nth") <= budget), "row", []), counts, 0)
    after = F.greatest(F.col("new") - plan.before, F.lit(0))
    left = F.greatest(after - budget, F.lit(0))
    status = plan.counts.select("repo_id", F.least(after, F.lit(budget)).cast("long").alias("embedded"), left.cast("long").alias("remaining"))
    status.withColumn("status", F.when(F.col("remaining") > 0, "indexing").otherwise("ready")).write.parquet(at)
    status = store.spark.read.schema("repo_id string, embedded long, remaining long, status string").parquet(at)
    taken = with_bit(incoming, "row", plan.picked, []).where("bit")
    done = E.hash_embed(taken.select(F.struct(*KEY, "content").alias("row"), "content"), "row", "content", dim)
    store.append(done.select("row.*", F.lit(model).alias("embed_model"), "embedding"), together=True)
    ready = status.where("status = 'ready'").where((F.col("embedded") > 0) | F.lit(plan.before == 0))  # the others were done before
    kept = incoming.select("repo_id", "content_hash", F.lit(model).alias("embed_model"))
    store.prune(lambda rows: rows.join(ready, "repo_id", "left_semi").join(kept, kept.columns, "left_anti"), f"{at}-gone")
    return status


def index_all(store: ChunkStore, incoming: DataFrame, model: str, budget: int, dim: int, at: str) -> int:
    """Passes until every repository is ready; gives their number.

    They run in rounds of 1, ROUND, ROUND ** 2, ... passes, so there are as many jobs as the logarithm of the passes, and a run
    that is stopped goes on by hash after its last whole round. A round tells what its passes embedded together. What is new
    is found and put in order once, for all rounds.
    """
    incoming = _numbered(incoming, f"{at}/sent")
    new, counts = _new(store, incoming, model, f"{at}/new")
    most = counts.agg(F.max("new")).first()[0] or 0
    ends = [budget]
    while ends[-1] < most:
        ends.append(ends[-1] * ROUND + budget)
    in_round = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end < F.col("nth")))
    picked = bitmaps(new.withColumn("round", in_round), "row", ["round"])
    picked.write.parquet(f"{at}/picked")
    picked = store.spark.read.schema(picked.schema).parquet(f"{at}/picked")
    for n, (low, high) in enumerate(zip([0, *ends], ends)):
        plan = Plan(picked.where(F.col("round") == n).drop("round"), counts, low)
        index_pass(store, incoming, model, high - low, dim, f"{at}/{n + 1}", plan)
    return max(-(-most // budget), 1)
