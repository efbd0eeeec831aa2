"""Repair of the structure of conversations by aligning turns to the alternating grammar (operator 11).

The roles of a sound conversation have initials of the form (s?(ua)+)?, and such a string is told by its length: even
lengths alternate from u, odd ones from three on have an s first. A conversation is aligned (Wagner and Fischer) to every
length whose lower bound isn't beyond the cost of the best alignment so far; that cost also bounds how far a cell may lie
off the diagonal (Ukkonen's bands). Audits are traced through the table of costs to the end, taking at each cell the first letter, in
ASCII, that keeps the cost; of lengths with the same cost the least audit wins. What matters of a turn is its role's
initial and its fault, so a task remembers the result of every sequence of those.

Turns are dealt to tasks by conversation, sorted by Spark and streamed, one conversation at a time. A conversation of more than
`most_rows` turns is split instead: its turns are ordered by ranges, cut into blocks, and each block becomes a 4 x 4 matrix
of the costs between the states of the grammar (nothing yet, after s, u or a). The matrices of a conversation, one for
4096 turns, give every block the costs of what follows it, and the block its audit for each state before it. This is the
same search, as all lengths of a parity share their states. Only the digest, which is sequential, streams through one task.

Defined cases: turns go by number, nulls first, ties by role and text; a null role or text is a space; a null conversation
id is a conversation of its own; a role without an initial can't be kept; repeated rows are duplicates; an empty table
gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spaces import materialize, parts, small_batches

MOST_ROWS = 128
BLOCK_BITS = 12
MEMO = 200_000
KEEP_TRUNCATED, REROLE, DELETE, INSERT = 3, 3, 4, 3
SPACES = " \t\n\x0b\x0c\r"
FAR = 1 << 40
#: States of the grammar: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
TO_END = (0, 2 * INSERT, INSERT, 0)  # inserts that each state needs at the end
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def told(role: str, text: str, seen: bool) -> str:
    """A turn as one letter: x if it must go, else its role's initial (o for any other), upper case if it is truncated."""
    bare = text.rstrip(SPACES)
    if not bare or seen:
        return "x" if not bare else "y"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if bare[-1] in ".!?" else initial.upper()


def wanted(m: int) -> str:
    return ("s" if m % 2 else "") + "ua" * (m // 2)


def align(turns: str, m: int, most: int) -> tuple[int, list[list[int]]]:
    """The least cost of turning `turns` into the string of length m, and the table of costs from each cell on; cells that no path of cost `most` meets are left out."""
    n, goal = len(turns), wanted(m)
    kept = [0]
    for t in turns:
        kept.append(kept[-1] + (t not in "xy"))
    slack = most - DELETE * (n - kept[n])
    more, less = slack // INSERT, slack // DELETE
    below = [FAR] * (m + 2)
    for j in range(m, -1, -1):
        below[j] = 0 if j == m else FAR if goal[j] == "s" else INSERT + below[j + 1]
    table = [below]
    for i in range(n - 1, -1, -1):
        t, row = turns[i], [FAR] * (m + 2)
        initial, late, gone = t.lower(), KEEP_TRUNCATED * t.isupper(), t in "xy"
        left = kept[n] - kept[i]
        low, high = max(0, kept[i] - less, m - left - more), min(m, kept[i] + more, m - left + less)
        for j in range(high, low - 1, -1):
            cost = DELETE + below[j]
            if j < m:
                g = goal[j]
                if not gone:
                    if g == initial:
                        cost = min(cost, late + below[j + 1])
                    elif g != "s":
                        cost = min(cost, REROLE + late + below[j + 1])
                if g != "s":
                    cost = min(cost, INSERT + row[j + 1])
            row[j] = cost
        table.append(row)
        below = row
    table.reverse()
    return table[0][0], table


def trace(turns: str, m: int, table: list[list[int]]) -> str:
    """The least audit, in ASCII, of all of the least cost."""
    n, goal, i, j, out = len(turns), wanted(m), 0, 0, []
    while i < n or j < m:
        cost, g = table[i][j], goal[j] if j < m else ""
        late = KEEP_TRUNCATED * (i < n and turns[i].isupper())
        gone = i == n or turns[i] in "xy"
        if i < n and cost == DELETE + table[i + 1][j]:
            out.append("D")
            i += 1
        elif g and g != "s" and cost == INSERT + table[i][j + 1]:
            out.append("I")
            j += 1
        elif g and not gone and g == turns[i].lower() and cost == late + table[i + 1][j + 1]:
            out.append("K")
            i, j = i + 1, j + 1
        else:
            out.append("R")
            i, j = i + 1, j + 1
    return "".join(out)


def repair_audit(turns: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of turns that told() gave."""
    n, gone, late = len(turns), sum(t in "xy" for t in turns), sum(t.isupper() for t in turns)

    def least(m: int) -> int:
        deleted, inserted = max(0, n - gone - m), max(0, m - (n - gone))
        return DELETE * (gone + deleted) + INSERT * inserted + KEEP_TRUNCATED * max(0, late - deleted)

    best, audit = DELETE * n, "D" * n  # length 0
    for m in sorted((m for m in range(2, n + best // INSERT + 1) if least(m) <= best), key=lambda m: (least(m), m)):
        if least(m) > best:
            break
        cost, table = align(turns, m, best)
        if cost <= best:
            found = trace(turns, m, table)
            if cost < best or found < audit:
                best, audit = cost, found
    return best, audit


class Writer:
    """The repaired turns, from the audit's letters and the turns in order."""

    def __init__(self):
        self.state, self.empty, self.digest, self.held = START, True, hashlib.sha256(), None

    def _put(self, role: str, text: str, state: int) -> None:
        said = f"{'' if self.empty else chr(10)}{role}:{text}"
        self.digest.update(said.encode("utf-8", "surrogatepass"))
        if self.held is not None:
            self.held.append(said)
        self.state, self.empty = state, False

    def _next(self) -> tuple[str, int]:
        return ("assistant", ASSISTANT) if self.state == USER else ("user", USER)

    def insert(self) -> None:
        role, state = self._next()
        self._put(role, "", state)

    def turn(self, letter: str, role: str, text: str) -> None:
        if letter == "K":
            self._put(role, text, AFTER[role[:1]])
        elif letter == "R":
            new, state = self._next()
            self._put(new, text, state)

    def spend(self, letters: Iterator[str], role: str, text: str) -> None:
        """The letters up to the one of this turn."""
        for letter in letters:
            if letter != "I":
                return self.turn(letter, role, text)
            self.insert()

    def end(self, letters: Iterable[str]) -> None:
        for _ in letters:
            self.insert()


def _conversation(rows: list[tuple], memo: dict, texts: bool) -> tuple:
    """What repair() tells of one conversation, from (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    letters, illegal = [], 0
    for k, (_, role, text) in enumerate(rows):
        letters.append(told(role, text, (role, text) in seen))
        seen.add((role, text))
        illegal += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    turns = "".join(letters)
    if turns not in memo:
        if len(memo) >= MEMO:
            memo.clear()
        memo[turns] = repair_audit(turns)
    cost, audit = memo[turns]
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    out, told_by = Writer(), iter(audit)
    out.held = [] if texts else None
    for _, role, text in rows:
        out.spend(told_by, role, text)
    out.end(told_by)
    return (gaps, turns.count("x"), turns.count("y"), sum(map(str.isupper, turns)), illegal, cost, audit, out.digest.hexdigest(), *(["".join(out.held)] if texts else []))


def _streamed(rows: DataFrame, kind: str, fields: str, texts: bool) -> DataFrame:
    """Conversations one after the other, from rows that are dealt by conversation and sorted."""
    names = ["conv", "gaps", *COUNTS, "cost", "audit", "repaired_sha256", *(["repaired"] if texts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, done, held, now, schema = {}, [], [], None, None
        for batch in batches:
            schema = pa.schema([("conv", batch.schema.field(0).type), *((c, pa.int64()) for c in ("gaps", *COUNTS, "cost")), *((c, pa.string()) for c in names[7:])])
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and conv != now:
                    done.append((now, *_conversation(held, memo, texts)))
                    held = []
                now = conv
                held.append(row)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if held:
            done.append((now, *_conversation(held, memo, texts)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    return small_batches(rows.repartition(parts(rows.sparkSession), "conv").sortWithinPartitions(*order).select("conv", "turn", "role", "text")).mapInArrow(run, fields)


# Conversations of more than most_rows turns.


def step(letter: str, after: list[int]) -> list[int]:
    """Costs from each state before a turn on, inserts before it included, from those after it."""
    late, initial = KEEP_TRUNCATED * letter.isupper(), letter.lower()
    out = [DELETE + after[q] for q in range(4)]
    if letter not in "xy":
        for q in range(4):
            follows = ASSISTANT if q == USER else USER
            out[q] = min(out[q], REROLE + late + after[follows])
            kept = AFTER.get(initial)
            if kept is not None and (kept == SYSTEM and q == START or kept == follows):
                out[q] = min(out[q], late + after[kept])
    for _ in range(2):  # at most two inserts in a row help
        out = [min(out[q], INSERT + out[ASSISTANT if q == USER else USER]) for q in range(4)]
    return out


def _greedy(turns: str, exit_costs: list[int], q: int) -> tuple[str, int]:
    """The least audit of a block from state q, and the state after it."""
    costs = [exit_costs]
    for t in reversed(turns):
        costs.append(step(t, costs[-1]))
    costs.reverse()
    out, i = [], 0
    while i < len(turns):
        t, cost, after, follows = turns[i], costs[i][q], costs[i + 1], ASSISTANT if q == USER else USER
        late, kept = KEEP_TRUNCATED * t.isupper(), AFTER.get(t.lower())
        if cost == DELETE + after[q]:
            out.append("D")
            i += 1
        elif cost == INSERT + costs[i][follows]:
            out.append("I")
            q = follows
        elif kept is not None and (kept == SYSTEM and q == START or kept == follows) and cost == late + after[kept]:
            out.append("K")
            q, i = kept, i + 1
        else:
            out.append("R")
            q, i = follows, i + 1
    return "".join(out), q


def _split(rows: DataFrame, kind: str, fields: str, texts: bool) -> DataFrame:
    """What _streamed() gives, for long conversations, of which no task holds more than a block of turns or its row for each block."""
    spark = rows.sparkSession
    order = ["conv", F.col("turn").asc_nulls_first(), "role"]
    ranged = rows.repartitionByRange(parts(spark), *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    ranged = materialize(ranged.withColumn("seq", F.monotonically_increasing_id()), "long-turns")  # ascends with the order
    first = ranged.groupBy("conv", "role", F.sha2("text", 256).alias("t")).agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    letter = F.when(bare == "", "x").when(F.col("first").isNull(), "y").when(F.substring(bare, -1, 1).isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    letters = ranged.join(first, "seq", "left").select("conv", F.shiftright("seq", BLOCK_BITS).alias("block"), "seq", letter.alias("letter"), F.substring("role", 1, 1).alias("initial"))

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        turns, initials = "".join(pdf["letter"]), pdf["initial"].tolist()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cells = []
        for q in range(4):
            costs = [0 if x == q else FAR for x in range(4)]
            for t in reversed(turns):
                costs = [min(x, FAR) for x in step(t, costs)]
            cells.append(costs)
        return pd.DataFrame({"conv": [pdf["conv"].iloc[0]], "block": [pdf["block"].iloc[0]], "turns": [turns], "first": [initials[0]], "last": [initials[-1]], "illegal": [illegal], "cells": [[int(x) for q in range(4) for x in np.array(cells)[:, q]]]})

    blocks = materialize(letters.groupBy("conv", "block").applyInPandas(matrix, f"conv {kind}, block long, turns string, first string, last string, illegal long, cells array<long>"), "long-blocks")

    def after(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ignore_index=True)
        now, found = list(TO_END), []
        for cells in reversed(pdf["cells"].tolist()):
            found.append(now)
            at = np.array(cells).reshape(4, 4)
            now = [int(min((at[q] + np.array(now)).min(), FAR)) for q in range(4)]
        joined = pdf["last"].shift(1).fillna("") + pdf["first"]
        illegal = int((~joined.iloc[1:].isin(["su", "ua", "au"])).sum())
        return pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "costs": found[::-1], "cost": now[START], "joints": illegal, "final": pdf.index == len(pdf) - 1})

    costs = blocks.select("conv", "block", "first", "last", "cells").groupBy("conv").applyInPandas(after, f"conv {kind}, block long, costs array<long>, cost long, joints long, final boolean")
    costs = materialize(costs, "long-costs")
    # A block of one range of rows has one conversation's turns, or ends of several; both tables have one row for each of these.
    same = (F.col("b.conv").eqNullSafe(F.col("c.conv"))) & (F.col("b.block") == F.col("c.block"))
    paired = blocks.alias("b").join(costs.alias("c"), same).select("b.conv", "b.block", "turns", "costs", "final")

    def audits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            each = [[_greedy(t, [int(x) for x in c], q) for q in range(4)] for t, c in zip(pdf["turns"], pdf["costs"])]
            yield pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "audits": [[a + "I" * (TO_END[q] // INSERT if f else 0) for a, q in x] for x, f in zip(each, pdf["final"])], "exits": [[q for _, q in x] for x in each]})

    told_by = paired.mapInPandas(audits, f"conv {kind}, block long, audits array<string>, exits array<int>")
    lines = ranged.select("conv", F.shiftright("seq", BLOCK_BITS).alias("block"), "seq", "role", "text", F.lit(None).cast("array<string>").alias("audits"), F.lit(None).cast("array<int>").alias("exits"))
    heads = told_by.select("conv", "block", F.lit(-1).cast("long").alias("seq"), F.lit("").alias("role"), F.lit("").alias("text"), "audits", "exits")
    flow = lines.unionByName(heads).repartition(parts(spark), "conv").sortWithinPartitions("conv", "block", "seq").drop("block")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, state, letters, all_letters = None, None, START, iter(()), []
        kinds = pa.schema([("conv", pa.null()), *((c, pa.string()) for c in ("audit", "repaired_sha256", *(["repaired"] if texts else [])))])

        def close() -> pa.RecordBatch:
            out.end(letters)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([now, "".join(all_letters), out.digest.hexdigest(), *(["".join(out.held)] if texts else [])], [conv_type, *kinds.types[1:]])], kinds.names)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, seq, role, text, audits, exits in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or conv != now:
                    if out is not None:
                        yield close()
                    now, out, state, letters, all_letters = conv, Writer(), START, iter(()), []
                    out.held = [] if texts else None
                if seq < 0:
                    letters = iter(audits[state])
                    all_letters.append(audits[state])
                    state = exits[state]
                else:
                    out.spend(letters, role, text)
        if out is not None:
            yield close()

    written = small_batches(flow.select("conv", "seq", "role", "text", "audits", "exits")).mapInArrow(write, f"conv {kind}, audit string, repaired_sha256 string" + ", repaired string" * texts)
    count = lambda x: F.count_if(F.col("letter") == x)
    sums = letters.groupBy("conv").agg(count("x").alias("blank"), count("y").alias("duplicate"), F.count_if(F.col("letter").isin("S", "U", "A", "O")).alias("truncated"))
    turn = ranged.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    inner = blocks.groupBy("conv").agg(F.sum("illegal").alias("inner"))
    joints = costs.groupBy("conv").agg(F.first("cost").alias("cost"), F.first("joints").alias("joints"))
    out = written
    for more in (sums, turn, inner, joints):
        more = more.withColumnRenamed("conv", "of")
        out = out.join(more, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    return out.select("conv", "gaps", "blank", "duplicate", "truncated", (F.col("inner") + F.col("joints")).alias("illegal"), "cost", "audit", "repaired_sha256", *(["repaired"] if texts else []))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", texts: bool = False, most_rows: int = MOST_ROWS) -> DataFrame:
    """A row per conversation: gaps, faults, the cost and audit of the cheapest repair and the digest of the repaired turns; with `texts` also those, as role:text in lines."""
    kind = dict(turns.dtypes)[conv_col]
    fields = f"conv {kind}, " + ", ".join(f"{c} long" for c in ("gaps", *COUNTS, "cost")) + ", audit string, repaired_sha256 string" + ", repaired string" * texts
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    long = materialize(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_rows).select(F.col("conv").alias("of")), "long-conversations")
    if long.isEmpty():
        out = _streamed(rows, kind, fields, texts)
    else:
        same = F.col("conv").eqNullSafe(F.col("of"))
        out = _streamed(rows.join(long, same, "left_anti"), kind, fields, texts).unionByName(_split(rows.join(long, same, "left_semi"), kind, fields, texts))
    return out.withColumnRenamed("conv", conv_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with the faults that the checksum of conversation and turn tells; nulls in it, in roles and in texts are a space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault")).where(F.col("fault") != 0)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = repair(damaged(table)).withColumnRenamed("conv_id", "of")
    every = table.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *COUNTS, "cost")]
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
