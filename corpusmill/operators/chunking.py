"""Files into chunks: symbols for code, sections for markdown, overlapping windows for what is long or has neither.

A file is a row from start to end: its lines are an array, marked, numbered and cut in place, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import columns as C

MAX_LINES, OVERLAP, MIN_CHARS = 120, 12, 24
MARK = "array<struct<ln:int,symbol:string,kind:string>>"


def marked_lines(files: DataFrame) -> DataFrame:
    """repo_id, path, lang, the lines of every file, and marks: ln (from 0), symbol and kind of those that start a segment."""
    split = files.where(F.col("content").isNotNull()).select("repo_id", "path", C.detect_lang(F.col("path")).alias("lang"), F.split("content", "\n").alias("lines"))
    # What a line matches is written once in each branch, as plans copy expressions.
    heading = lambda line: F.when(line.rlike(C.HEADING), F.struct(C.trimmed(F.regexp_extract(line, C.HEADING, 1)).alias("symbol"), F.lit("section").alias("kind")))

    def told(match: Callable) -> F.Column:
        return F.filter(F.transform("lines", lambda line, ln: F.struct(ln.alias("ln"), match(line).alias("m"))), lambda x: x["m"].isNotNull())

    found = F.when(F.col("lang") == "markdown", told(heading))
    for lang in C.signed_languages():
        found = found.when(F.col("lang") == lang, told(lambda line, lang=lang: C.match_signature(line, lang)))
    split = split.withColumn("found", found)
    marks = F.coalesce(F.transform("found", lambda x: F.struct(x["ln"].alias("ln"), x["m"]["symbol"].alias("symbol"), x["m"]["kind"].alias("kind"))), F.array()).cast(MARK)
    return split.withColumn("marks", marks).drop("found")


def _heads(marked: DataFrame) -> DataFrame:
    """marked with its segments: an array of what starts each, its first line and one past its last, numbered from 0 where something comes before the first mark."""
    unmarked = F.when(F.col("lang") == "markdown", "section").when(F.size("marks") == 0, "file").otherwise("preamble")
    before = F.array(F.struct(F.lit(0).alias("ln"), F.lit(None).cast("string").alias("symbol"), unmarked.alias("kind")))
    led = (F.size("marks") > 0) & (F.coalesce(F.try_element_at("marks", F.lit(1))["ln"], F.lit(-1)) == 0)
    heads = marked.withColumn("led", led).withColumn("heads", F.when(F.col("led"), F.col("marks")).otherwise(F.concat(before, "marks")))
    ends = F.concat(F.slice(F.transform("heads", lambda h: h["ln"]), 2, F.size("heads")), F.array(F.size("lines")))
    spans = F.zip_with("heads", ends, lambda h, end: F.struct(h["ln"].alias("start"), (end - 1).alias("stop"), h["symbol"].alias("symbol"), h["kind"].alias("kind")))
    return heads.select("repo_id", "path", "lang", "lines", "led", spans.alias("spans"))


def segments(marked: DataFrame) -> DataFrame:
    """repo_id, path, lang, seg, symbol, kind, start and stop (lines from 0); seg 0 is what comes before the first mark."""
    # There is always a span; the outer form keeps Spark from filtering empty arrays by writing all patterns once more.
    one = _heads(marked).select("repo_id", "path", "lang", "led", F.posexplode_outer("spans").alias("nth", "s"))
    return one.select("repo_id", "path", "lang", (F.col("nth") + F.col("led").cast("int")).alias("seg"), "s.symbol", "s.kind", "s.start", "s.stop")


def windows(marked: DataFrame, most: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Segments, those longer than `most` lines cut into windows that overlap; repo_id, path, lang, symbol, kind, start, stop, content.

    A file's windows are cut from its array of lines while it is one row, so a row that leaves holds its own lines only.
    """
    step = most - overlap

    def cut(s: Column) -> Column:
        last = F.ceil(F.greatest(F.lit(0), s["stop"] - s["start"] + 1 - most) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda w: piece(s, s["start"] + w * step))

    def piece(s: Column, low: Column) -> Column:
        high = F.least(low + most - 1, s["stop"])
        content = F.array_join(F.slice("lines", low + 1, high - low + 1), "\n")
        return F.struct(s["symbol"].alias("symbol"), s["kind"].alias("kind"), low.alias("start"), high.alias("stop"), content.alias("content"))

    return _heads(marked).select("repo_id", "path", "lang", F.inline_outer(F.flatten(F.transform("spans", cut))))


def chunk_corpus(files: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Chunks of all files: repo_id, path, lang, symbol, symbol_kind, start_line, end_line (from 1), content and content_hash."""
    cut = windows(marked_lines(files)).where(F.length(C.trimmed(F.col("content"))) >= least)
    return cut.select("repo_id", "path", "lang", "symbol", F.col("kind").alias("symbol_kind"), (F.col("start") + 1).alias("start_line"), (F.col("stop") + 1).alias("end_line"), "content", C.content_hash(F.col("path"), F.col("start"), F.col("content")).alias("content_hash"))
