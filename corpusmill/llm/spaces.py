"""Where intermediate tables of the operators live: the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources.corpus import spread


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one is set only where the session names none and runs on this machine alone (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif re.match(r"local($|\[)", sc.master):
            named = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
            sc.setCheckpointDir(named)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named.rstrip("/")


def free_name(columns: Iterable[str], name: str) -> str:
    """name, with as many _ in front as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Paths of the tables that are still there, by the name of their owner; None owns what no scratch() is around.
_written: dict[str | None, list[str]] = {}
_owners: list[str | None] = [None]


@contextlib.contextmanager
def scratch(owner: str) -> Iterator[None]:
    """Tables that materialize() writes inside belong to owner, whom sweep() names."""
    _owners.append(owner)
    try:
        yield
    finally:
        _owners.pop()


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not keep:
        _written.setdefault(_owners[-1], []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.scratch_path)
        for held in _written.values():
            if t.scratch_path in held:
                held.remove(t.scratch_path)


def sweep(spark: SparkSession, owner: str) -> None:
    """Deletes the tables of one owner. Only for where all results that read them have been written."""
    for path in _written.pop(owner, []):
        _delete(spark, path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, after asking its session for Arrow batches of at most `rows` rows: long texts make a default batch tens of MB."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > rows:
        conf.set(key, str(rows))
    return df
