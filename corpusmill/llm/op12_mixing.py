"""Scoring of texts by online logistic context mixing (operator 12).

A text is its words, in lower case, and one end. What is scored is the sequence of these tokens, of the known words and of one
more kind, unknown, so the probabilities of all sequences sum to one. Frequent words, the end and an escape have Huffman
codes, so a token is a string of bits, few of them for a word that is met often. Each bit is predicted from four contexts:
none (the counts of the words below this node of the code), the last very frequent word, the last word, and the last two.
The last three are hashed with the node into tables of counts of zeros and ones. What the predictors say, in the logistic
domain, is summed with the weights of a gate (depth in the code, which contexts were met before), and a correction of these
weights is learned online along every stretch of SEGMENT bits of a text, from the error of each block of bits. A stretch
starts from the fitted weights, so long texts are worked on side by side. After an escape a known word takes its share of the
counts of all words without codes, less DISCOUNT, and unknown words the share of the words met once. bits_per_byte adds the
spelling of unknown words, by the frequencies of bytes, so that it is the cost of the whole text.

What is met once is unknown to a count that leaves it out, so while tables are counted a word needs one use more for its code.

Counts of words and of contexts come from all training rows (of contexts from all but one row in CALIBRATION_SHARE, on
which the weights are fitted), gathered by Spark: words as sums, tables as blocks of slots that are added up as they
stream through tasks. Tables have a slot for every 32 training tokens, at most 2**MOST_BITS for each context, so they are
broadcast; when contexts are more, they share slots, as hashed contexts do. Counts of words are exact at any size: the most
frequent ones, at most `model_words`, are broadcast, all others meet the texts that have them in a join. Words are told by
64 bits of hash.

Defined cases: a null or empty text is the end alone; a null id belongs to no fold, so such rows are scored but not learned
from; rows that repeat count and are scored each; without training rows every count is 0; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .folds import fold
from .spaces import documents, materialize, parts, small_batches

MODEL_WORDS, CODED_WORDS, GUIDES = 2_000_000, 1 << 16, 256
LEAST_BITS, MOST_BITS, TOKENS_PER_SLOT = 12, 22, 32
BLOCK_SLOTS = 4096
TASK_TOKENS = 1 << 25
CALIBRATION_SHARE, NEWTON_STEPS = 64, 25
HASHED = 3  # contexts with tables
INPUTS = HASHED + 2  # and the codes' own counts, and a constant
DEPTHS = 12
GATES = DEPTHS * 4
PRIOR = 0.4  # count of what was not met
DISCOUNT = 0.5
SEGMENT, STEP, RATE = 2048, 64, 0.01
HELD_WORDS = 1_000_000
END, ESCAPE, FIRST_WORD = 0, 1, 2
STOP = 256
START_HASH, END_HASH = tv.U64(0x5851F42D4C957F2D), tv.U64(0x14057B7EF767814F)


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes in lower case, hashes, starts and ends of all words, and the index of the first word of each text."""
    low = tv.lower_ascii(buf)
    starts, ends, first = tv.ascii_words(low, offsets)
    return low, tv.span_hash(tv.prefix_hash(low), starts, ends), starts, ends, first


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, key and n: words (0) by hash, their bytes (1) by value, and texts (2), summed within tasks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, rows, held, many = np.zeros(STOP + 1, np.int64), 0, [], 0

        def batch_of(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])

        def closed() -> tuple[np.ndarray, np.ndarray]:
            (keys,), (n,) = tv.pair_counts(np.concatenate([k for k, _ in held]), weights=[np.concatenate([n for _, n in held])])
            return keys, n

        for batch in batches:
            buf, off = tv.text_views(batch.column(0))
            rows += batch.num_rows
            for i, j in tv.chunks(off):
                low, h, starts, ends, _ = words_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                held.append(np.unique(h.view(np.int64), return_counts=True))
                many += len(held[-1][0])
                spelled[:STOP] += np.bincount(low, minlength=STOP)
                spelled[STOP] += len(h)
                if many > HELD_WORDS:
                    held = [closed()]
                    many = len(held[0][0])
                    if many > HELD_WORDS // 2:
                        yield batch_of(0, *held.pop())
                        many = 0
        if held:
            yield batch_of(0, *closed())
        yield batch_of(1, np.arange(STOP + 1), spelled)
        yield batch_of(2, np.zeros(1, np.int64), np.array([rows]))

    return small_batches(texts.select(text_col)).mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of two symbols or more, at most 31 (counts are levelled until they are)."""
    counts = np.maximum(counts.astype(np.int64), 1)
    while True:
        n = len(counts)
        parent, order = np.zeros(2 * n - 1, np.int64), [(int(c), k) for k, c in enumerate(counts)]
        heapq.heapify(order)
        for new in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(order), heapq.heappop(order)
            parent[x] = parent[y] = new
            heapq.heappush(order, (a + b, new))
        depth = np.zeros(2 * n - 1, np.int64)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if depth[:n].max() <= 31:
            return depth[:n]
        counts = counts // 2 + 1


class Code:
    """A canonical prefix code: length and left-aligned bits of each symbol, and for each bit what the counts say of it."""

    def __init__(self, counts: np.ndarray):
        self.lengths = code_lengths(counts)
        order = np.lexsort((np.arange(len(counts)), self.lengths))
        sizes = (1 << (32 - self.lengths[order])).astype(np.int64)
        at = np.cumsum(sizes) - sizes
        self.bits = np.zeros(len(counts), np.int64)
        self.bits[order] = at
        below = np.concatenate([[0], np.cumsum(np.maximum(counts[order], 0))]).astype(float)
        self.first = np.cumsum(self.lengths) - self.lengths
        symbol, depth = np.repeat(np.arange(len(counts)), self.lengths), tv.expand(np.zeros(len(counts), np.int64), self.lengths)
        low = self.bits[symbol] >> (32 - depth) << (32 - depth)
        a, b, c = (below[np.searchsorted(at, x)] for x in (low, low + (1 << (31 - depth)), low + (1 << (32 - depth))))
        self.said = np.log((c - b + PRIOR) / (b - a + PRIOR)).astype(np.float32)


class Coder:
    """Turns texts into bits with their contexts. What is broadcast is arrays; a worker makes its map once."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, spelled: np.ndarray, rows: int, once: int, rest: int, bits: int):
        """Words by falling count, counts of bytes and stops, training rows, words met once, and the discounted sum of words that aren't among these."""
        self.words, self.counts, self.bits, self.ends = words, counts, bits, rows
        self.coded = min(CODED_WORDS, int((counts >= 2).sum()))
        self.coded_left_out = min(self.coded, int((counts >= 3).sum()))
        own = counts[self.coded :]
        self.once = max(once, 1)
        self.escaped = self.once + rest + float(own.sum()) - DISCOUNT * len(own)
        self.code = Code(np.concatenate([[rows, int(self.escaped)], counts[: self.coded]]) + 1)
        self.spelling = -np.log2((spelled + 1) / (spelled.sum() + len(spelled)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each word among the broadcast ones, most frequent first; -1 for others."""
        if not hasattr(self, "map"):
            self.map = tv.HashMap64()
            self.map.put(self.words, np.arange(len(self.words)))
        return self.map.get(h)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "map"}

    def stream(self, buf: np.ndarray, offsets: np.ndarray, left_out: bool = False) -> dict:
        """For all texts: bits, what the codes say of each, its gate's lower part, its slots; edges of the texts' bits; the words."""
        low, h, starts, ends, first = words_of(buf, offsets)
        n = np.diff(first)
        texts, at = len(n), self.find(h)
        # Words with an end after each text's.
        place, tail = np.arange(len(h)) + np.repeat(np.arange(texts), n), first[1:] + np.arange(texts)
        total, head = len(h) + texts, first[:-1] + np.arange(texts)
        hashes, symbol, guide = np.empty(total, tv.U64), np.full(total, END), np.zeros(total, bool)
        hashes[place], hashes[tail] = h, END_HASH
        symbol[place] = np.where((at >= 0) & (at < (self.coded_left_out if left_out else self.coded)), at + FIRST_WORD, ESCAPE)
        guide[place] = (at >= 0) & (at < GUIDES)

        def shifted(x: np.ndarray) -> np.ndarray:
            out = np.empty_like(x)
            out[1:] = x[:-1]
            out[head] = START_HASH
            return out

        one = shifted(hashes)
        two = tv.mix_with(shifted(one), 3) + one
        last = np.maximum.accumulate(np.where(guide, np.arange(total), -1))
        last = np.concatenate([[-1], last[:-1]]) if total else last
        led = np.where(last >= np.repeat(head, n + 1), hashes[np.maximum(last, 0)], START_HASH)
        lengths = self.code.lengths[symbol]
        of = np.repeat(np.arange(total), lengths)
        depth = tv.expand(np.zeros(total, np.int64), lengths)
        bits = self.code.bits[symbol][of]
        node = ((1 << depth) | (bits >> (32 - depth))).astype(tv.U64) * tv.U64(tv.MULTIPLIER)
        slots = [(((tv.mix_with(c, 11 + k)[of] ^ node) * tv.MIX_A) >> tv.U64(64 - self.bits)).astype(np.int64) for k, c in enumerate((led, one, two))]
        edges = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([head, [total]])]
        return {"bit": ((bits >> (31 - depth)) & 1).astype(np.int8), "said": self.code.said[self.code.first[symbol][of] + depth], "gate": np.minimum(depth, DEPTHS - 1) * 4, "slots": slots, "edges": edges, "n": n, "first": first, "hashes": h, "at": at, "low": low, "starts": starts, "ends": ends}

    def spell(self, s: dict, words: np.ndarray) -> np.ndarray:
        """Bits that spelling each of the words takes."""
        size = s["ends"][words] - s["starts"][words]
        edges = np.concatenate([[0], np.cumsum(size)])
        return tv.sums(self.spelling[s["low"][tv.expand(s["starts"][words], size)]], edges) + self.spelling[STOP]


def tables(texts: DataFrame, coder: Broadcast, bits: int, tokens: int, text_col: str = "text") -> np.ndarray:
    """What each slot says of its bit, in the logistic domain, from all texts: HASHED rows of 2**bits.

    Every task sends its tables, so tasks take partitions together until each has about TASK_TOKENS, or there are no more
    tasks than cores: what moves stays in proportion to the input.
    """
    wide, tasks = 2 * BLOCK_SLOTS, max(texts.sparkSession.sparkContext.defaultParallelism, -(-tokens // TASK_TOKENS))
    packed = lambda x: x.astype(np.uint16 if x.max() < 1 << 16 else np.uint32).tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((HASHED << bits) * 2, np.uint32)
        for batch in batches:
            buf, off = tv.text_views(batch.column(0))
            for i, j in tv.chunks(off):
                s = coder.value.stream(buf[off[i] : off[j]], off[i : j + 1] - off[i], left_out=True)
                for k, slot in enumerate(s["slots"]):
                    np.add.at(held, (slot + (k << bits)) * 2 + s["bit"], np.uint32(1))
        blocks = held.reshape(-1, wide)
        some = np.flatnonzero(blocks.any(axis=1))
        for i in range(0, len(some), 256):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 256].astype(np.int32)), pa.array([packed(x) for x in blocks[some[i : i + 256]]], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:  # one after the other: a task holds a sum for each of its blocks, however many tasks counted
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = counts.as_buffer()
                held[block] = held.get(block, 0) + np.frombuffer(data, np.uint16 if data.size == 2 * wide else np.uint32).astype(np.int64)
        for block, total in held.items():
            zeros, ones = total[0::2], total[1::2]
            said = np.log((ones + PRIOR) / (zeros + PRIOR)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([said.tobytes()], pa.binary())], ["block", "said"])

    each = small_batches(texts.select(text_col).coalesce(tasks)).mapInArrow(count, "block int, counts binary")
    summed = each.repartition(parts(texts.sparkSession), "block").mapInArrow(add, "block int, said binary").toArrow()  # two bytes a slot
    out = np.zeros(((HASHED << bits) // BLOCK_SLOTS, BLOCK_SLOTS), np.float16)
    for block, said in zip(summed["block"].to_pylist(), summed["said"]):
        out[block] = np.frombuffer(said.as_buffer(), np.float16)
    return out.reshape(HASHED, -1)


def inputs(s: dict, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the predictors say of each bit, and its gate."""
    x = np.empty((len(s["bit"]), INPUTS), np.float32)
    x[:, 0], x[:, -1] = s["said"], 1
    for k, slot in enumerate(s["slots"]):
        x[:, k + 1] = said[k][slot]
    return x, s["gate"] + (x[:, 2] != 0) * 2 + (x[:, 3] != 0)


def gate_sums(x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For every gate the gradient and the Hessian of the cost of these bits, one row after the other."""
    out = np.zeros((GATES, INPUTS * (INPUTS + 1)))
    order = np.argsort(gate, kind="stable")
    edges = np.searchsorted(gate[order], np.arange(GATES + 1))
    for g in np.flatnonzero(np.diff(edges)):
        some = order[edges[g] : edges[g + 1]]
        a = x[some].astype(float)
        p = 1 / (1 + np.exp(-np.clip(a @ weights[g], -20, 20)))
        out[g, :INPUTS] = a.T @ (p - bit[some])
        out[g, INPUTS:] = ((a * (p * (1 - p))[:, None]).T @ a).reshape(-1)
    return out


def newton(weights: np.ndarray, start: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The step of every gate, at most one long in any weight, drawn towards the start."""
    grad, hess = sums[:, :INPUTS], sums[:, INPUTS:].reshape(-1, INPUTS, INPUTS)
    step = np.linalg.solve(hess + 20 * np.eye(INPUTS), (grad + 20 * (weights - start))[:, :, None])[:, :, 0]
    return step * np.minimum(1.0, 1.0 / (np.abs(step).max(axis=1, keepdims=True) + 1e-12))


def fit_gates(texts: DataFrame, coder: Broadcast, said: Broadcast) -> np.ndarray:
    """Weights of every gate by Newton steps of a logistic regression over all bits of texts, drawn towards what the codes' counts say.

    A step is a pass: tasks send a gradient and a Hessian of every gate, whatever they read.
    """
    start = np.zeros((GATES, INPUTS))
    start[:, 0] = 1
    weights = start.copy()
    for _ in range(NEWTON_STEPS):

        def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros((GATES, INPUTS * (INPUTS + 1)))
            for batch in batches:
                buf, off = tv.text_views(batch.column(0))
                for i, j in tv.chunks(off):
                    s = coder.value.stream(buf[off[i] : off[j]], off[i : j + 1] - off[i], left_out=True)
                    total += gate_sums(*inputs(s, said.value), s["bit"], weights)
            if total.any():
                gates = np.flatnonzero(total.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(gates), pa.array(list(total[gates]), pa.list_(pa.float64()))], ["gate", "sums"])

        each = texts.mapInArrow(run, "gate long, sums array<double>").select("gate", F.posexplode("sums").alias("at", "x"))
        total = np.zeros((GATES, INPUTS * (INPUTS + 1)))
        for r in each.groupBy("gate", "at").agg(F.sum("x").alias("x")).collect():  # a row for each gate and place
            total[r["gate"], r["at"]] = r["x"]
        step = newton(weights, start, total)
        weights = weights - step
        if np.abs(step).max() < 1e-7:
            break
    return weights.round(4).astype(np.float32)  # the order of addition tells only far below


def mixed(s: dict, said: np.ndarray, weights: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Bits that each text costs: the weights of a bit's gate and a correction, learned along the text's stretches."""
    x, gate = inputs(s, said)
    z0, edges = np.einsum("ij,ij->i", weights[gate], x), s["edges"]
    sign = s["bit"].astype(np.float32) * 2 - 1
    many = -(-np.diff(edges) // SEGMENT)
    nth = tv.expand(np.zeros(len(many), np.int64), many)
    doc = np.repeat(np.arange(len(many)), many)
    start = edges[doc] + nth * SEGMENT
    length = np.minimum(SEGMENT, edges[doc + 1] - start)
    order = np.argsort(-length, kind="stable")
    start, length, doc = start[order], length[order], doc[order]
    change, cost = np.zeros((len(start), INPUTS), np.float32), np.zeros(len(start))
    for k in range(0, int(length.max(initial=0)), STEP):
        n = int(np.searchsorted(-length, -k, side="left"))
        here = np.minimum(STEP, length[:n] - k)
        at = tv.expand(start[:n] + k, here)
        first, a, y = np.cumsum(here) - here, x[at], sign[at]
        z = np.clip(z0[at] + np.einsum("ij,ij->i", np.repeat(change[:n], here, axis=0), a), -16, 16)
        e = np.exp(-y * z)  # an error is the share that the wrong side had
        cost[:n] += np.add.reduceat(np.log1p(e).astype(float), first)
        change[:n] += rate * np.add.reduceat((y * (e / (1 + e)))[:, None] * a, first, axis=0)
    return np.bincount(doc, cost, len(many)) / np.log(2)


class Model:
    def __init__(self, coder: Broadcast, mixer: Broadcast, tail: DataFrame | None, train_tokens: int, distinct: int):
        self.coder, self.mixer, self.tail, self.train_tokens, self.distinct = coder, mixer, tail, train_tokens, distinct


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_words: int = MODEL_WORDS, most_bits: int = MOST_BITS) -> Model:
    """A model of all rows of docs, the training ones."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = materialize(word_counts(texts), "mixing-words")
    words = counted.where(F.col("kind") == 0)
    rows, tokens, distinct = counted.agg(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.count_if(F.col("kind") == 0)).first()
    rows, tokens = rows or 0, tokens or 0
    many, least = 0, 0
    for r in words.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("n")).collect():
        if many + r["many"] > model_words:
            least = r["n"] + 1
            break
        many += r["many"]
    top = words.where(F.col("n") >= least).select("key", "n").toArrow()  # at most model_words rows
    key, n = top["key"].to_numpy(), top["n"].to_numpy()
    order = np.lexsort((key, -n))
    key, n = key[order].view(tv.U64), n[order]
    spelled = np.zeros(STOP + 1, np.int64)
    for r in counted.where(F.col("kind") == 1).collect():  # a row for each byte
        spelled[r["key"]] = r["n"]
    once, rest, others = words.agg(F.count_if(F.col("n") == 1), F.sum(F.when(F.col("n") < least, F.col("n"))), F.count_if(F.col("n") < least)).first()
    bits = int(min(max(int(np.ceil(np.log2(max(tokens + rows, 2) / TOKENS_PER_SLOT))), LEAST_BITS), most_bits))
    coder = spark.sparkContext.broadcast(Coder(key, n, spelled, rows, once, (rest or 0) - DISCOUNT * others, bits))
    del top
    calibrates = F.pmod(F.xxhash64("id", "text"), F.lit(CALIBRATION_SHARE)) == 0
    said = spark.sparkContext.broadcast(tables(texts.where(~calibrates), coder, bits, tokens))

    held = materialize(texts.where(calibrates).select("text"), "mixing-calibration")
    weights = fit_gates(small_batches(held), coder, said)
    tail = materialize(words.where(F.col("n") < least).select("key", F.col("n").alias("c")), "mixing-rare-words") if least else None
    return Model(coder, spark.sparkContext.broadcast((said.value, weights)), tail, tokens + rows, distinct + (rows > 0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """id_col, n_tokens, n_known, base_score and score (log10 probabilities of the tokens) and bits_per_byte (of the text and its end) of every text."""
    kind = dict(docs.dtypes)[id_col]
    coder, mixer, rare = model.coder, model.mixer, model.tail is not None
    names = [id_col, "row", "n_tokens", "n_known", "logs", "more", "bits", "spelling", "size", "lost"]
    pair = pa.struct([("key", pa.int64()), ("spelling", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said, weights = mixer.value
        c = coder.value
        for batch in batches:
            buf, off = tv.text_views(batch.column(2))
            for i, j in tv.chunks(off):
                s = c.stream(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                at, n, many = s["at"], s["n"], j - i
                of = np.repeat(np.arange(many), n)
                count = np.where(at >= 0, c.counts[np.maximum(at, 0)], 0) if len(c.counts) else np.zeros(len(at), np.int64)
                # Words that aren't among the broadcast ones are told apart later if there are others.
                away = np.flatnonzero(at < 0)
                spelling, lost = c.spell(s, away), away if rare else away[:0]
                share = np.where(at >= c.coded, np.log10(np.maximum(count - DISCOUNT, DISCOUNT)), 0.0)
                if not rare:
                    share[away] = np.log10(c.once)
                escapes = (at < 0) | (at >= c.coded)
                share[escapes] -= np.log10(c.escaped)
                known = (count > 0).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[lost], np.arange(many + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(s["hashes"][lost].view(np.int64)), pa.array(spelling[: len(lost)])], fields=list(pair)))
                sums = lambda x, w=of, k=many: np.bincount(w, x, k).astype(float)
                cols = [n + 1, sums(known).astype(np.int64) + (c.ends > 0), sums(np.log10(count + 1.0)) + np.log10(c.ends + 1.0), sums(share), mixed(s, said, weights, rate), sums(spelling, of[away]) if not rare else np.zeros(many), np.diff(off[i : j + 1])]
                yield pa.RecordBatch.from_arrays([*(x.slice(i, many) for x in batch.columns[:2]), *map(pa.array, cols), lists], names)

    rows = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("__row"), F.col(text_col).alias("__text"))
    out = small_batches(rows).mapInArrow(run, f"`{id_col}` {kind}, row long, n_tokens long, n_known long, logs double, more double, bits double, spelling double, size long, lost array<struct<key: long, spelling: double>>")
    if rare:
        out = materialize(out, "mixing-scores")
        once = F.lit(float(np.log10(coder.value.once)))
        lost = out.select("row", F.inline("lost")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("spelling").alias("spelling")).join(model.tail, "key", "left")
        lost = lost.groupBy(F.col("row").alias("of")).agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_logs"),
            F.sum(F.col("n") * F.when(F.col("c").isNull(), once).otherwise(F.log10(F.col("c") - DISCOUNT))).alias("rare_more"), F.sum(F.when(F.col("c").isNull(), F.col("spelling")).otherwise(0.0)).alias("spelled"),
        )
        out = out.join(lost, F.col("row") == F.col("of"), "left")
        for c, add in (("n_known", "known"), ("logs", "rare_logs"), ("more", "rare_more"), ("spelling", "spelled")):
            out = out.withColumn(c, F.col(c) + F.coalesce(F.col(add), F.lit(0)))
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(model.train_tokens + model.distinct + 1)))
    told = F.col("more") - F.col("bits") * F.lit(float(np.log10(2)))
    return out.select(id_col, "n_tokens", "n_known", base.alias("base_score"), told.alias("score"), ((F.col("spelling") - told / F.lit(float(np.log10(2)))) / (F.col("size") + 1)).alias("bits_per_byte"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs.where(fold("doc_id", 7) != 2))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
