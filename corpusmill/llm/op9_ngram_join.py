"""N-gram Jaccard join, size-aware with light and heavy sets (operator 9).

A document's set holds the hashes of its distinct word shingles. Equal sets become one node. Two sets with Jaccard
similarity of t or more share at least ceil(t * size) elements of either one, so, in one global order of elements, their
first size - ceil(t * size) + c elements share at least c. Light sets, up to a boundary, put every subset of c = 2 of
those elements in the join; heavy sets, and light ones that are large enough to match a heavy one, put every single
one (c = 1) in inverted lists. The boundary minimises the expected number of rows, from the histogram of sizes and the
mean list length. In the global order, elements that a count in fixed space shows as frequent come last, the others by
hash, so that lists stay short; which ones count as frequent changes the work, never the result.

Lists are not expanded into pairs. In each list every member first meets one leader; pairs that sizes and a parity
signature cannot rule out are verified on the full sets, and components are built. Lists whose members are in one
component are done, and members only meet those of another component. After LEADER_ROUNDS rounds, members of the
remaining lists meet every member of another component, the exact way for the rest, again behind the signature, which
gives a lower bound of the sets' difference and is wide enough for a set's size to rule out unrelated ones.

Equal sets and nodes are told apart by a 64-bit sum of hashes. Defined cases: a text without words, or null, has an
empty set and is linked with nothing; a text with fewer words than a shingle has its whole sequence as one; of rows
that repeat an id each is returned; a null id is never a component's name unless no other is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .components import components
from .sketches import bucket_counts, slots
from .spaces import documents, drop, free_name, materialize, small_batches

SHINGLE, PERCENT = 3, 90
SKETCH_BITS = 20
SIGNATURE = 32  # lanes of 64 bits
NARROW, NARROW_SIZE = 8, 2_000  # lanes of sets up to that size in the last round's lists, of which unrelated sets differ in too many bits to link
LEADER_ROUNDS = 2
FILTER_BITS = 23


def sets(buf: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the index of the first one of each text."""
    low = tv.lower_ascii(buf)
    starts, ends, first = tv.ascii_words(low, offsets)
    n = np.diff(first)
    if not len(starts):
        return np.zeros(0, tv.U64), np.zeros(len(offsets), np.int64)
    word = tv.span_hash(tv.prefix_hash(low), starts, ends)
    doc = np.repeat(np.arange(len(n)), n)
    room = first[1:][doc] - np.arange(len(word))
    at = np.flatnonzero((room >= shingle) | ((n < shingle)[doc] & (room == n[doc])))
    mixed = np.zeros(len(at), tv.U64)
    for k in range(shingle):
        inside = room[at] > k
        mixed = tv.mix(mixed + np.where(inside, word[np.minimum(at + k, len(word) - 1)], tv.U64(k + 1)))
    order = np.lexsort((mixed, doc[at]))
    mixed, owner = mixed[order], doc[at][order]
    new = np.ones(len(mixed), bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (owner[1:] != owner[:-1])
    mixed, owner = mixed[new], owner[new]
    return mixed, np.searchsorted(owner, np.arange(len(n) + 1))


def names(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit name of each set, the same for equal sets; 0 for an empty one."""
    size = np.diff(first)
    total = np.concatenate([np.zeros(1, tv.U64), np.cumsum(tv.mix_with(elements, 3))])
    return np.where(size > 0, tv.mix(total[first[1:]] - total[first[:-1]] + size.astype(tv.U64)), tv.U64(0))


def need(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    return -(-size * percent // 100)


def boundary(histogram: dict[int, int], mean_list: float, percent: int) -> int:
    """Largest light size: where the subsets of light sets and the scanned lists of heavy ones cost least together."""
    sizes = np.array(sorted(histogram), np.int64)
    count = np.array([histogram[s] for s in sizes], np.float64)
    prefix = sizes - need(sizes, percent) + 1
    light, heavy = prefix * (prefix + 1) / 2, prefix * (1.0 + mean_list)
    total = np.concatenate([[0.0], np.cumsum(light * count)]) + np.concatenate([np.cumsum((heavy * count)[::-1])[::-1], [0.0]])
    k = int(np.argmin(total))
    return int(sizes[k - 1]) if k else 0


def join_keys(elements: np.ndarray, first: np.ndarray, use: np.ndarray, hot: np.ndarray, bits: int, edge: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which the sets marked by `use` meet, and how many each has."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    keep = use[doc]
    elements, doc = elements[keep], doc[keep]
    order = np.lexsort((elements, hot[slots(elements, bits)], doc))
    elements, doc = elements[order], doc[order]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    prefix = size - need(size, percent) + 1
    single = (size * 100 > edge * percent)[doc] & (place < prefix[doc])
    keys, owner = [tv.mix_with(elements[single], 5)], [doc[single]]
    two = (size <= edge)[doc] & (place < (prefix + 1)[doc])
    e, d, p = elements[two], doc[two], place[two]
    for step in range(1, int(p.max()) + 1 if len(p) else 1):
        a = np.flatnonzero(d[step:] == d[:-step])
        keys.append(tv.mix(tv.mix_with(e[a], 6) + e[a + step]))
        owner.append(d[a])
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    return keys[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(size))


def signatures(elements: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Parity of the elements that fall on each bit, so that two sets' differing bits are at most their differing elements.

    A set has as many bits as elements, rounded up to a power of two; a longer signature folds to a shorter one by XOR
    of its halves. Returned are all sets' signatures folded to SIGNATURE * 64 bits, and the whole ones.
    """
    n, size = len(first) - 1, np.diff(first)
    least = SIGNATURE * 64
    width = np.maximum(least, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(n), size)
    bit = (tv.mix_with(elements, 8) & (width[owner] - 1).astype(tv.U64)).astype(np.int64)
    odd = np.bincount(base[owner] + bit, minlength=int(base[-1])).astype(np.uint8) & 1
    packed = np.packbits(odd, bitorder="little")
    short = np.bincount(owner * least + (bit & (least - 1)), minlength=n * least).reshape(n, least).astype(np.uint8) & 1
    return np.packbits(short, axis=1, bitorder="little").view("<i8"), [packed[base[k] // 8 : base[k + 1] // 8].tobytes() for k in range(n)]


def least_apart(a: bytes, b: bytes) -> int:
    """Differing bits of two whole signatures, the longer one folded."""
    x, y = np.frombuffer(a, tv.U64), np.frombuffer(b, tv.U64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def nodes(docs: DataFrame, id_col: str, text_col: str, hot: np.ndarray, edge: int, percent: int, shingle: int) -> DataFrame:
    """id, size and node of every row; keys and signature too, for the first of a set in its task that can match another set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = tv.HashMap64()
        for batch in batches:
            buf, off = tv.text_views(batch.column(1))
            for i, j in tv.chunks(off):
                elements, first = sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                size, name = np.diff(first), names(elements, first)
                use = (size > 0) & (need(size, percent) * 100 <= size * percent)  # other sizes match equal sets only
                use |= need(size + 1, percent) <= size
                use &= seen.get(name) < 0
                fresh, at = np.unique(name[use], return_index=True)
                use[np.setdiff1d(np.flatnonzero(use), np.flatnonzero(use)[at])] = False
                if seen.size > 500_000:
                    seen = tv.HashMap64()
                seen.put(fresh[seen.get(fresh) < 0], np.zeros(int((seen.get(fresh) < 0).sum())))
                keys, count = join_keys(elements, first, use, hot, SKETCH_BITS, edge, percent)
                lanes, whole = signatures(elements, first)
                edges = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.view(np.int64)))
                sig = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * SIGNATURE, SIGNATURE, dtype=np.int32)), pa.array(lanes.reshape(-1)))
                none = pa.array([None] * (j - i), sig.type)
                sig = pa.compute.if_else(pa.array(use), sig, none)
                whole = pa.array([x if u else None for x, u in zip(whole, use)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size), pa.array(name.view(np.int64)), batch.column(2).slice(i, j - i), lists, sig, whole], ["id", "size", "node", "text_hash", "keys", "sig", "whole"])

    return small_batches(docs.select(F.col(id_col).cast("long"), text_col, _text_hash(text_col))).mapInArrow(run, "id long, size long, node long, text_hash long, keys array<long>, sig array<long>, whole binary")


def _text_hash(text_col: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _apart(a: str, b: str, lanes: int) -> F.Column:
    return sum((F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(lanes)), F.lit(0))


def _folded(lanes: int) -> list[F.Column]:
    """The signature in s0, s1, ... folded to fewer lanes."""
    out = []
    for k in range(lanes):
        lane = F.col(f"s{k}")
        for more in range(k + lanes, SIGNATURE, lanes):
            lane = lane.bitwiseXOR(F.col(f"s{more}"))
        out.append(lane.alias(f"s{k}"))
    return out


def _may_link(percent: int, lanes: int = SIGNATURE) -> F.Column:
    """False where sizes or signatures of the rows a and b rule out the similarity."""
    both = F.col("a.size") + F.col("b.size")
    return _sizes_fit("a.size", "b.size", percent) & (_apart("a", "b", lanes) * (100 + percent) <= both * (100 - percent))


def _sizes_fit(a: str, b: str, percent: int) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _rest(lists: DataFrame, short: DataFrame, percent: int, lanes: int, which: F.Column) -> DataFrame:
    """Pairs a, b of one list and two components that sizes and signatures don't rule out; members of a list's main component don't meet each other."""
    leaders = lists.groupBy("key").agg(F.min_by("comp", F.xxhash64("node")).alias("main"))
    known = lists.select("key", "node", "comp").join(leaders, "key").join(short.select("node", "size", *_folded(lanes)), "node")
    apart = (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
    met = known.where(F.col("comp") != F.col("main")).alias("a").join(known.alias("b"), (F.col("a.key") == F.col("b.key")) & apart & which & _may_link(percent, lanes))
    return met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def full_sets(docs: DataFrame, text_col: str, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and its elements, for the nodes and text hashes in wanted: of all texts only those past a filter of fixed size are cut anew."""
    bits = 1 << FILTER_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(bits, bool)
        for batch in batches:
            on[slots(batch.column(0).to_numpy().view(tv.U64), FILTER_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(on))], ["at"])

    on = np.zeros(bits, bool)
    for r in wanted.select("text_hash").mapInArrow(mark, "at long").distinct().groupBy(F.floor(F.col("at") / 4096).alias("block")).agg(F.collect_list((F.col("at") % 4096).cast("int")).alias("at")).collect():
        on[int(r.block) * 4096 + np.array(r.at)] = True  # at most 2**FILTER_BITS places
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(on))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            _, pick = np.unique(batch.column(1).to_numpy(), return_index=True)
            pick = np.sort(pick)
            pick = pick[here[slots(batch.column(1).to_numpy()[pick].view(tv.U64), FILTER_BITS)]]
            buf, off = tv.text_views(batch.column(0).take(pa.array(pick)))
            for i, j in tv.chunks(off):
                elements, first = sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
                raw = [elements[first[k] : first[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(names(elements, first).view(np.int64)), pa.array(raw, pa.binary())], ["node", "elements"])

    found = small_batches(docs.select(text_col, _text_hash(text_col))).mapInArrow(run, "node long, elements binary").join(wanted.select("node").distinct(), "node", "left_semi")
    return materialize(found.dropDuplicates(["node"]), "full-sets")


def verified(docs: DataFrame, text_col: str, pairs: DataFrame, about: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Those pairs a, b of nodes that link: whole signatures rule most others out, full sets decide."""
    one, two = (about.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("whole").alias(f"whole_{x}")) for x in ("a", "b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.array([least_apart(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(apart * (100 + percent) <= size * (100 - percent), pa.bool_()))

    closer = small_batches(pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "size_a", "size_b", "whole_a", "whole_b")).mapInArrow(near, "a long, b long")
    pairs = materialize(closer, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(about.select("node", "text_hash"), "node")
    full = full_sets(docs, text_col, wanted, shingle)
    left = full.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = full.select(F.col("node").alias("b"), F.col("elements").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(v.as_buffer(), tv.U64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    found = materialize(small_batches(both, 200).mapInArrow(run, "a long, b long"), "verified")
    drop(pairs, full)
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """id, n_shingles and component_id of every row."""
    counts = bucket_counts(docs, lambda buf, off: sets(buf, off, shingle)[0], text_col, SKETCH_BITS)
    # Beyond six standard deviations of a bucket filled by rare elements alone, some element is frequent.
    hot = counts > counts.mean() + 6 * np.sqrt(counts.mean()) + 8
    cool = counts[~hot].astype(float)
    mean_list = max(0.0, float((cool**2).sum() / max(cool.sum(), 1) - cool.mean() - 1))
    guess = F.least(F.floor(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) / 6), F.lit(2000))  # of a set's size, only for the costs
    histogram = {max(r.size, 1): r.n for r in docs.groupBy(guess.alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2000 rows
    edge = boundary(histogram, mean_list, percent)
    rows = materialize(nodes(docs, id_col, text_col, hot, edge, percent, shingle), "jaccard-nodes")
    unique = materialize(rows.where(F.col("sig").isNotNull()).dropDuplicates(["node"]), "jaccard-sets")
    full, rows = rows, materialize(rows.select("id", "size", "node"), "jaccard-rows")
    drop(full)
    about = materialize(unique.select("node", "size", "text_hash", "whole", *(F.col("sig")[k].alias(f"s{k}") for k in range(SIGNATURE))), "jaccard-signatures")
    short = about.drop("whole", "text_hash")
    entries = unique.select("node", "size", F.explode("keys").alias("key"))
    listed = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    lists = materialize(entries.join(listed.select("key"), "key", "left_semi").withColumn("comp", F.col("node")), "lists")
    drop(unique)
    links = None
    for turn in range(LEADER_ROUNDS + 1):
        if links is not None:
            comp = components(links)
            labelled = materialize(lists.drop("comp").join(comp, "node", "left").select("key", "node", "size", F.coalesce("comp", "node").alias("comp")), "labelled")
            old = lists
            drop(old)
            open_lists = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).where((F.col("low") != F.col("high")) & (F.col("n") > 2))
            lists = materialize(labelled.join(open_lists.select("key"), "key", "left_semi"), "lists")
            drop(labelled, comp)
        if turn < LEADER_ROUNDS:
            # First one node leads many lists, so that few pairs settle most; then every list draws its own leader.
            order = F.xxhash64("node", "key") if turn else F.xxhash64("node")
            leaders = lists.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("leader"), F.col("size").alias("leader_size"), F.col("comp").alias("leader_comp")), order).alias("l")).select("key", "l.*")
            met = lists.join(leaders, "key").where((F.col("comp") != F.col("leader_comp")) & _sizes_fit("size", "leader_size", percent))
            met = met.select(F.least("node", "leader").alias("x"), F.greatest("node", "leader").alias("y")).distinct()
            a, b = short.withColumnRenamed("node", "x").alias("a"), short.withColumnRenamed("node", "y").alias("b")
            pairs = met.join(a, "x").join(b, "y").where(_may_link(percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))
        else:
            pairs = _rest(lists, short.where(F.col("size") <= NARROW_SIZE), percent, NARROW, F.greatest("a.size", "b.size") <= NARROW_SIZE)
            pairs = pairs.unionByName(_rest(lists, short.where(F.col("size") * 100 >= NARROW_SIZE * percent), percent, SIGNATURE, F.greatest("a.size", "b.size") > NARROW_SIZE))
        more = verified(docs, text_col, pairs, about, percent, shingle)
        links = more if links is None else links.unionByName(more)
    comp = components(links)
    ids = rows.where(F.col("size") > 0).groupBy("node").agg(F.min("id").alias("low"))
    named = ids.join(comp, "node", "left").select("node", "low", F.coalesce("comp", "node").alias("comp"))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    labels = materialize(named.join(lowest, "comp").select("node", "component_id"), "jaccard-labels")
    drop(about, lists, comp)
    full = rows.where(F.col("size") > 0).select("id", "size", "node").join(labels, "node").select("id", F.col("size").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where(F.col("size") == 0).select("id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """All columns of one document of each component: the smallest id, a null id after all others, then the first row."""
    row = free_name(docs.columns, "row")
    base = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-base")
    found = jaccard_components(base, row, text_col, percent, shingle)
    near = materialize(found.join(base.select(F.col(row).alias("id"), F.col(id_col).alias("own")), "id"), "jaccard-rows")
    first = near.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "id")).alias("first")).select(F.col("first.id").alias(row))
    gone = near.select(F.col("id").alias(row)).join(first, row, "left_anti")
    return base.join(gone, row, "left_anti").select(*docs.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
