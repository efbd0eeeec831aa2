"""Rate limiting over a table of requests: a fixed window per key, anchored at its first request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = "id long, key long, allowed boolean, remaining int, reset_in_us long"


class KeyWindow:
    """The open window of one key: when it ends and how many requests it has let through."""

    __slots__ = ("reset", "count")

    def __init__(self, reset: int | None = None, count: int = 0):
        self.reset, self.count = reset, count

    def ask(self, t: int, limit: int, window_us: int) -> tuple[bool, int, int]:
        """allowed, remaining and microseconds to the window's end; denied requests don't count."""
        if self.reset is None or self.reset <= t:
            self.reset, self.count = t + window_us, 1
            return True, limit - 1, window_us
        if self.count >= limit:
            return False, 0, self.reset - t
        self.count += 1
        return True, limit - self.count, self.reset - t


HOT = 1_000_000  # requests of a key that one task may walk through


def replay(requests: DataFrame, limit: int, window_us: int, key: str = "key", ts: str = "ts", id_col: str = "id", hot: int = HOT, at: str | None = None) -> DataFrame:
    """id, key, allowed, remaining and reset_in_us of every request, in order of time and id.

    Requests are dealt by key and sorted; a task walks through its rows with one open window in hand, so its memory
    does not grow with a key's history. A key of more than `hot` requests is spread over tasks instead (spread_out(), which
    writes its steps at `at`), if such a place is named.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, KeyWindow()
        for pdf in batches:
            told = []
            for i, k, t in zip(pdf["id"].tolist(), pdf["key"].tolist(), pdf["t"].tolist()):
                if k != current:
                    current, window = k, KeyWindow()
                told.append((i, k, *window.ask(t, limit, window_us)))
            yield pd.DataFrame(told, columns=["id", "key", "allowed", "remaining", "reset_in_us"])

    rows = requests.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    walked = lambda df: df.repartition("key").sortWithinPartitions("key", "t", "id").mapInPandas(walk, FIELDS)
    if at is None:
        return walked(rows)
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key")
    many.write.parquet(f"{at}/hot")
    many = rows.sparkSession.read.schema(many.schema).parquet(f"{at}/hot")
    if many.isEmpty():
        return walked(rows)
    return walked(rows.join(many, "key", "left_anti")).unionByName(spread_out(rows.join(many, "key", "left_semi"), limit, window_us, at))


def spread_out(rows: DataFrame, limit: int, window_us: int, at: str) -> DataFrame:
    """What replay() gives, of rows (id, key, t), with a key's requests over many tasks.

    Time is cut into blocks as long as a window, so at most one window begins in a block. The request that begins the next window,
    if one begins at t, is the first one at or after t + window: in the next block, or the first one of a later block. Windows are
    what the key's first request leads to, found by doubling these pointers. A request belongs to the window that began last; only
    the first `limit` ones of a window are numbered, all others are denied.
    """
    spark = rows.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.expr(f"t div {window_us} - IF(t < 0 AND t % {window_us} <> 0, 1, 0)")), "rows")
    times = kept(rows.select("key", "block", "t").distinct(), "times")
    firsts = times.groupBy("key", "block").agg(F.min("t").alias("first"))
    later = firsts.withColumn("later", F.lead("first").over(Window.partitionBy("key").orderBy("block")))
    later = later.withColumn("after_that", F.lead("first", 2).over(Window.partitionBy("key").orderBy("block"))).withColumn("next_block", F.lead("block").over(Window.partitionBy("key").orderBy("block")))
    # Within a block the first request at or after each time a window of the block before ends.
    ends = times.select("key", (F.col("block") + 1).alias("block"), (F.col("t") + window_us).alias("t"), F.lit(None).cast("long").alias("found"), F.col("t").alias("of"))
    asked = times.select("key", "block", "t", F.col("t").alias("found"), F.lit(None).cast("long").alias("of")).unionByName(ends)
    ahead = Window.partitionBy("key", "block").orderBy(F.desc("t"), F.col("of").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = asked.withColumn("to", F.last("found", True).over(ahead)).where(F.col("of").isNotNull()).select("key", F.col("block") - 1, F.col("of").alias("t"), "to").toDF("key", "block", "t", "to")
    # Without one it is the first of the next block that isn't the one after.
    skip = F.when(F.col("next_block") == F.col("block") + 1, F.col("after_that")).otherwise(F.col("later"))
    step = kept(near.join(later.select("key", "block", skip.alias("skip")), ["key", "block"]).select("key", "t", F.coalesce("to", "skip").alias("to")).where(F.col("to").isNotNull()), "step-0")
    starts, n = kept(times.groupBy("key").agg(F.min("t").alias("t")), "starts-0"), 0
    while True:
        n += 1
        more = starts.join(step, ["key", "t"]).select("key", F.col("to").alias("t"))
        if more.isEmpty():
            break
        starts = kept(starts.unionByName(more).distinct(), f"starts-{n}")
        two = step.select("key", F.col("t").alias("to"), F.col("to").alias("far"))
        step = kept(step.join(two, ["key", "to"]).select("key", "t", F.col("far").alias("to")), f"step-{n}")
    begun = starts.select("key", F.expr(f"t div {window_us} - IF(t < 0 AND t % {window_us} <> 0, 1, 0)").alias("block"), F.col("t").alias("start"))
    # Every block of requests with the window that begins in it and the last one before.
    over = Window.partitionBy("key").orderBy("block")
    blocks = firsts.select("key", "block").join(begun, ["key", "block"], "left").withColumn("before", F.last("start", True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    placed = rows.join(blocks, ["key", "block"]).withColumn("start", F.when(F.col("t") >= F.col("start"), F.col("start")).otherwise(F.col("before"))).select("id", "key", "t", "row", "start")
    nth = F.row_number().over(Window.partitionBy("key", "start").orderBy("t", "id", "row"))
    let = placed.withColumn("nth", nth).where(F.col("nth") <= limit).select("row", "nth")
    out = placed.join(let, "row", "left")
    return out.select("id", "key", F.col("nth").isNotNull().alias("allowed"), F.coalesce(F.lit(limit) - F.col("nth"), F.lit(0)).cast("int").alias("remaining"), (F.col("start") + window_us - F.col("t")).alias("reset_in_us"))
