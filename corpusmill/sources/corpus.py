"""Reading and filtering the files of many repositories."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import columns as C

ARCHIVE_BYTES, HELD_BYTES = 1 << 20, 1 << 26  # contents of an archive, and what a task holds of archives or files at once


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if its files give them too few partitions; a table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """repo_id, path, content and bytes of all files under root, one folder per repository; the archive's own top folder goes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    # Paths come back with the root as the file system spells it, so what is below starts after the root's own last folder.
    last = re.escape(root.rstrip("/").rsplit("/", 1)[-1])
    below = F.regexp_replace("path", rf"^.*?/{last}/", "")
    return raw.select(F.substring_index(below, "/", 1).alias("repo_id"), F.regexp_replace(below, r"^[^/]+/[^/]+/", "").alias("path"), F.col("content"), F.col("length").alias("bytes"))


def packed(files: DataFrame, top: str = "top") -> DataFrame:
    """repo_id and archive: files (repo_id, path and binary content) as tar archives of about ARCHIVE_BYTES of a repository, below a top folder.

    A task packs the files that it reads, so many files are few rows; a file without a path is one without a name.
    """
    schema = T.StructType([files.schema["repo_id"], T.StructField("archive", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, tuple[io.BytesIO, tarfile.TarFile]] = {}
        sizes: dict[object, int] = {}

        def closed(repos: list) -> pa.RecordBatch:
            out = []
            for repo in repos:
                data, tar = held.pop(repo)
                tar.close()
                out.append(data.getvalue())
            return pa.RecordBatch.from_arrays([pa.array(repos, kind), pa.array(out, pa.binary())], schema.names)

        total = 0
        for batch in batches:
            kind = batch.column(0).type
            for repo, path, content in zip(*batch.columns):
                repo, content = repo.as_py(), content.as_py() or b""
                if repo not in held:
                    data = io.BytesIO()
                    held[repo], sizes[repo] = (data, tarfile.open(fileobj=data, mode="w")), 0
                member = tarfile.TarInfo(f"{top}/{path.as_py() or ''}")
                member.size = len(content)
                held[repo][1].addfile(member, io.BytesIO(content))
                held[repo][1].members.clear()  # else an open archive remembers every file's header
                sizes[repo] += len(content) + 2 * tarfile.BLOCKSIZE
                total += len(content) + 2 * tarfile.BLOCKSIZE
                if sizes[repo] >= ARCHIVE_BYTES:
                    total -= sizes.pop(repo)
                    yield closed([repo])
                elif total >= HELD_BYTES:
                    yield from (closed([r]) for r in list(held))
                    total = 0
                    sizes.clear()
        yield from (closed([r]) for r in list(held))

    return files.select("repo_id", "path", "content").mapInArrow(run, schema)


def scan_archives(archives: DataFrame) -> DataFrame:
    """repo_id, path, content and bytes of all files in tar archives (repo_id and archive), gzipped or not; the archive's own top folder goes."""
    schema = T.StructType([archives.schema["repo_id"], T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("bytes", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, data in zip(*batch.columns):
                if not data.as_py():
                    continue
                paths, contents, size = [], [], 0

                def told(repo: pa.Scalar = repo) -> pa.RecordBatch:
                    cols = [pa.array([repo.as_py()] * len(paths), repo.type), pa.array(paths, pa.string()), pa.array(contents, pa.binary()), pa.array(list(map(len, contents)), pa.int64())]
                    return pa.RecordBatch.from_arrays(cols, schema.names)

                with tarfile.open(fileobj=io.BytesIO(data.as_py()), mode="r:*") as tar:
                    for member in tar:
                        if not member.isfile():
                            continue
                        paths.append(member.name.partition("/")[2] or None)
                        contents.append(tar.extractfile(member).read())
                        size += len(contents[-1])
                        if size >= HELD_BYTES:
                            yield told()
                            paths, contents, size = [], [], 0
                if paths:
                    yield told()

    return archives.select("repo_id", "archive").mapInArrow(run, schema)


def decoded(files: DataFrame) -> DataFrame:
    """Scanned files with content as text: bytes that are no UTF-8 become replacement characters."""
    return files.withColumn("content", F.decode("content", "UTF-8"))


def strip_top_folder(files: DataFrame) -> DataFrame:
    return files.withColumn("path", F.regexp_replace("path", r"^[^/]+/", ""))


def indexable(files: DataFrame) -> DataFrame:
    return files.where(C.should_index(F.col("path"), F.col("bytes")))


def without_binaries(files: DataFrame) -> DataFrame:
    """Files without a NUL in their first bytes."""
    if dict(files.dtypes)["content"] == "binary":
        return files.where(F.expr(f"position(x'00', substring(content, 1, {C.NUL_WINDOW})) = 0"))
    return files.where(F.instr(F.substring("content", 1, C.NUL_WINDOW), "\0") == 0)


def cap_files(files: DataFrame, most: int = 1500) -> DataFrame:
    """The first `most` files of each repository by path, which is the feature: a giant repository must not fill the index."""
    nth = F.row_number().over(Window.partitionBy("repo_id").orderBy("path"))
    return files.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


# What an address and a short name of a repository look like.
ADDRESS = r"github\.com[/:]([^/]+)/([^/]+?)(?:/tree/([^/]+))?$"
SHORT_NAME = r"^([^/\s]+)/([^/@\s]+)(?:@(.+))?$"


def parse_repos(inputs: DataFrame, col: str = "input") -> DataFrame:
    """input, owner, name, ref, repo_id and error from addresses or owner/name[@ref]; bad rows have an error."""
    text = F.regexp_replace(C.trimmed(F.col(col)), r"\.git$", "")
    url, short = ADDRESS, SHORT_NAME
    part = lambda k: F.when(text.rlike(url), F.regexp_extract(text, url, k)).when(text.rlike(short), F.regexp_extract(text, short, k))
    out = inputs.select(F.col(col).alias("input"), part(1).alias("owner"), part(2).alias("name"), F.when(part(3) == "", "HEAD").otherwise(part(3)).alias("ref"))
    slug = F.lower(F.concat("owner", F.lit("/"), "name", F.lit("@"), "ref"))
    return out.withColumn("repo_id", slug).withColumn("error", F.when(F.col("owner").isNull(), F.concat(F.lit("names no repository: "), "input")))
