"""Whole-batch text work on UTF-8 bytes with numpy.

Arrow hands a task its texts as one byte buffer plus offsets. The helpers here find words, classes of
characters and hashes for all texts of a batch at once, so no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: An odd multiplier of the polynomial hash and the constants of the splitmix64 finaliser.
MULTIPLIER = 0x9E3779B97F4A7C15
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CHUNK_BYTES = 512 << 10

_tables: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, which spreads every input bit over the result."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x = x ^ (x >> U64(27))
    x = x * MIX_B
    return x ^ (x >> U64(31))


def mix_with(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + U64((seed * MULTIPLIER + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


def _byte_values() -> np.ndarray:
    if "bytes" not in _tables:
        _tables["bytes"] = mix(np.arange(1, 257, dtype=U64) * U64(MULTIPLIER))
    return _tables["bytes"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse modulo 2**64, kept between calls up to 1 M entries."""
    have = _tables.get("powers")
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 131072)
        one, inv = np.full(size, MULTIPLIER, dtype=U64), np.full(size, pow(MULTIPLIER, -1, 1 << 64), dtype=U64)
        one[0] = inv[0] = 1
        have = np.cumprod(one), np.cumprod(inv)
        if size <= 1 << 20:
            _tables["powers"] = have
    return have


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of the bytes: entry i covers buf[:i]."""
    pw, _ = powers(len(buf))
    out = np.empty(len(buf) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(_byte_values()[buf] * pw[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    _, inv = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(MULTIPLIER))


def text_views(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a string or binary column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Returns freed memory to the system: workers live long, and their heaps would otherwise keep their largest size."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text stands alone. What the texts took is given back at the end."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
    if n and offsets[n] - offsets[0] > limit:
        give_back()


def class_table() -> np.ndarray:
    """Class of every code point: space, letter, number or other, by Unicode category; White_Space counts as space."""
    if "classes" not in _tables:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        # The code points with the Unicode property White_Space.
        spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        table[spaces] = SPACE
        _tables["classes"] = table
    return _tables["classes"]


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, code points and byte lengths of the characters beyond ASCII in valid UTF-8."""
    pos = np.flatnonzero(buf >= 0xC0)
    lead = buf[pos].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    cp = np.where(size == 2, lead & 0x1F, np.where(size == 3, lead & 0x0F, lead & 0x07))
    for k in (1, 2, 3):
        at = size > k
        cp[at] = (cp[at] << 6) | (buf[pos[at] + k] & 0x3F)
    return pos, cp, size


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of each byte's character."""
    table = class_table()
    out = table[:256][buf]
    pos, cp, size = code_points(buf)
    if len(pos):
        kind = table[cp]
        out[pos] = kind
        for k in (1, 2, 3):
            at = size > k
            out[pos[at] + k] = kind[at]
    return out


#: The bytes of [\x20\x09-\x0D].
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def ascii_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space inside each text, and the index of the first word of each text."""
    solid = ~ASCII_SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    bounds = offsets[:-1]
    inside = bounds[bounds < len(buf)]
    first[inside] = solid[inside]  # a word never runs over from one text into the next
    last = solid.copy()
    last[:-1] &= first[1:] | ~solid[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of solid bytes inside each text, and the index of the first run of each text."""
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inside = offsets[:-1][offsets[:-1] < len(solid)]
    first[inside] = solid[inside]  # a run never goes on from one text into the next
    last = solid.copy()
    last[:-1] &= first[1:] | ~solid[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    up = (buf >= 65) & (buf <= 90)
    return buf | (up.astype(np.uint8) << 5)


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for count[i] places, one run after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(total)


class HashMap64:
    """Open-addressing map from distinct 64-bit hashes to integers, probed for many keys at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * U64(MULTIPLIER)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        slot, mask = self._slots(h), (1 << self.bits) - 1
        out = self.values[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & mask
            s = slot[wrong]
            v = self.values[s]
            out[wrong] = v
            wrong = wrong[(v >= 0) & (self.keys[s] != h[wrong])]
        return out

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are distinct and not yet held."""
        if (self.size + len(h)) * 2 > len(self.keys):
            held = self.values >= 0
            old = self.keys[held], self.values[held]
            while (self.size + len(h)) * 2 > (1 << self.bits):
                self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32)
            self._place(*old)
        self._place(h, values.astype(np.int32))
        self.size += len(h)

    def _place(self, h: np.ndarray, values: np.ndarray) -> None:
        slot, mask, left = self._slots(h), (1 << self.bits) - 1, np.arange(len(h))
        while len(left):
            s = slot[left]
            free = self.values[s] < 0
            cand = left[free]
            owner = np.full(len(cand), -1)
            if len(cand):
                at, pick = np.unique(slot[cand], return_index=True)
                won = cand[pick]
                self.keys[at], self.values[at] = h[won], values[won]
                owner = won
            done = np.zeros(len(h), bool)
            done[owner] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & mask


def letter_words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters inside each text, and the index of the first word of each text."""
    solid = (byte_classes(buf) if kind is None else kind) == LETTER
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inside = offsets[:-1][offsets[:-1] < len(buf)]
    first[inside] = solid[inside]
    last = solid.copy()
    last[:-1] &= first[1:] | ~solid[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the accented Latin letters of two bytes that start with C3; byte lengths stay."""
    out = lower_ascii(buf)
    if len(out) > 1:
        up = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return np.diff(total[first])


def maxima(values: np.ndarray, first: np.ndarray, empty: float = 0.0) -> np.ndarray:
    """Maxima of values[first[i]:first[i + 1]], `empty` where there is none."""
    out = np.full(len(first) - 1, empty, np.float64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(values[: first[-1]], first[full])
    return out


def pair_counts(*keys: np.ndarray, weights: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of the key columns with the sums of each weight, for pre-aggregation inside a task."""
    if not len(keys[0]):
        return list(keys), [w.astype(np.int64) for w in weights]
    order = np.lexsort(keys[::-1])
    cols = [k[order] for k in keys]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
    at = np.flatnonzero(new)
    return [c[at] for c in cols], [np.add.reduceat(w[order].astype(np.int64), at) for w in weights]
