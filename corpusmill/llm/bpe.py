"""Batched byte-pair encoding: merge rounds over the symbols of many words at once."""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex

from . import textvec as tv

NO_RANK = np.int32(2**31 - 1)
LONG_WORD = 400
KEPT_WORDS = 300_000

#: The pattern by which byte-level tokenizers cut a text before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def byte_letters() -> list[str]:
    """The visible letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Bpe:
    """A BPE vocabulary read from a tokenizers JSON file; word_end is appended to the last symbol of every word, where the file has one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.rank_of = {int(k): i for i, k in enumerate(keys)}
        back = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for text, i in vocab.items():
            body, tail = (text[: -len(self.suffix)], b" ") if self.suffix and text.endswith(self.suffix) else (text, b"")
            pieces[i] = bytes(back[c] for c in body) + tail
        for text, i in self.special.items():
            pieces[i] = text.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])[:-1]
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search over the sorted pair keys; NO_RANK where it is no merge."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each word, given all words' symbols in one flat array, in rounds.

        A round takes the lowest-rank pair of every word and merges it where it stands, from the left, in all
        words at once; words without a mergeable pair leave. Very long words are merged one by one with a heap.
        """
        n = len(counts)
        out_count = np.zeros(n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.cumsum(counts) - counts
        for w in np.flatnonzero(counts > LONG_WORD):
            ids = self._merge_one(symbols[starts[w] : starts[w] + counts[w]])
            out_count[w] = len(ids)
            done.append((np.full(len(ids), w), ids))
        word = np.repeat(np.arange(n), counts)
        keep = (counts <= LONG_WORD)[word]
        sym, word = symbols[keep].astype(np.int32), word[keep]
        rank = np.full(len(sym), NO_RANK, np.int32)
        if len(sym) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self.rank(sym[same], sym[same + 1])
        while len(sym):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(sym)))
            over = low == NO_RANK
            if over.any():
                ends = np.repeat(over, size)
                done.append((word[ends], sym[ends]))
                out_count[word[head[over]]] = size[over]
                stay = ~ends
                sym, word, rank = sym[stay], word[stay], rank[stay]
                low, size = low[~over], size[~over]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == np.repeat(low, size))
            if len(pick) > 1:  # of overlapping equal pairs every other one counts, from the left
                run = np.concatenate([[True], np.diff(pick) != 1])
                place = np.arange(len(pick))
                pick = pick[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            sym[pick] = self.made[rank[pick]]
            stay = np.ones(len(sym), bool)
            stay[pick + 1] = False
            moved = (np.cumsum(stay) - 1)[pick]
            sym, word, rank = sym[stay], word[stay], rank[stay]
            fresh = np.concatenate([moved, moved[moved > 0] - 1])
            rank[fresh] = NO_RANK
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh] = self.rank(sym[fresh], sym[fresh + 1])
        if not done:
            return np.zeros(0, np.int32), out_count
        owner = np.concatenate([d[0] for d in done])
        return np.concatenate([d[1] for d in done]).astype(np.int32)[np.argsort(owner, kind="stable")], out_count

    def _merge_one(self, symbols: np.ndarray) -> np.ndarray:
        sym, n = symbols.astype(int).tolist(), len(symbols)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.rank_of.get((sym[i] << 32) | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], nxt[i] = int(self.made[r]), False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (q := self.rank_of.get((sym[x] << 32) | sym[y])) is not None:
                    heapq.heappush(heap, (q, x, sym[x], sym[y]))
        return np.array([s for s, ok in zip(sym, alive) if ok], np.int32)

    def encode_words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words buf[starts[i]:ends[i]], one after the other, and how many each has."""
        counts = ends - starts
        symbols = self.first[buf[tv.expand(starts, counts)]]
        if self.suffix and len(symbols):
            tails = np.cumsum(counts) - 1
            symbols[tails] = self.last[buf[ends - 1]]
        return self.merge(symbols, counts)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, special tokens included."""
        return self.pieces[tv.expand(self.piece_at[ids], self.piece_len[ids])].tobytes()


class WordCache:
    """Ids of the words met so far in this worker, by 64-bit hash; it starts anew beyond a fixed number of words."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.map, self.at, self.len, self.pool = tv.HashMap64(), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.words = self.used = 0

    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the given words and how many each has."""
        if self.words > KEPT_WORDS:
            self.clear()
        slot = self.map.get(hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh, where, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            pick = new[where]
            ids, count = self.bpe.encode_words(buf, starts[pick], ends[pick])
            n = len(fresh)
            self.pool, self.at, self.len = _room(self.pool, self.used + len(ids)), _room(self.at, self.words + n), _room(self.len, self.words + n)
            self.pool[self.used : self.used + len(ids)] = ids
            self.at[self.words : self.words + n] = self.used + np.cumsum(count) - count
            self.len[self.words : self.words + n] = count
            slots = np.arange(self.words, self.words + n)
            self.map.put(fresh, slots)
            slot[new] = slots[back]
            self.used, self.words = self.used + len(ids), self.words + n
        count = self.len[slot]
        return self.pool[tv.expand(self.at[slot], count)], count


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


def load(path: str) -> WordCache:
    """The vocabulary at path with this worker's cache of words."""
    if path not in _loaded:
        _loaded[path] = WordCache(Bpe(path))
    return _loaded[path]


def _contractions(buf: np.ndarray, start: np.ndarray, text_start: np.ndarray) -> None:
    """Moves the cuts at 's, 't, 'm, 'd, 're, 've and 'll where the quote opens a token."""
    quote = np.flatnonzero((buf[:-1] == 0x27) & start[:-1] & ~text_start[1:])
    pad = np.concatenate([buf, np.zeros(2, np.uint8)])
    a, b = pad[quote + 1], pad[quote + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
    open_next = np.concatenate([start, [True, True, True]])
    one &= open_next[quote + 1]
    two &= open_next[quote + 1] & ~open_next[quote + 2]
    for at, size in ((quote[one], 2), (quote[two & ~one], 3)):
        start[at + 1] = False
        after = at + size
        after = after[after < len(buf)]
        start[after] = True


def cut_byte_level(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of BYTE_LEVEL in each text, found on the bytes of all texts at once."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = tv.byte_classes(buf)
    inner = (buf & 0xC0) == 0x80
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    text_start = text_start[:n]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= text_start
    space = kind == tv.SPACE
    # The last white-space character before a visible one stands apart; a plain space opens the next token.
    visible = np.flatnonzero(start & ~space & ~text_start)
    visible = visible[space[visible - 1]]
    prev = visible - 1
    while (deep := inner[prev]).any():
        prev = np.where(deep, prev - 1, prev)
    start[prev] = True
    plain = buf[prev] == 0x20
    start[visible[plain]] = False
    _contractions(buf, start, text_start)
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n)


def cut_with_regex(text: str) -> list[bytes]:
    return [m.encode() for m in regex.findall(BYTE_LEVEL, text)]


def encode_texts(cache: WordCache, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the number of ids of each; special tokens' strings get their ids."""
    special = _special_spans(cache.bpe, buf, offsets)
    bounds = offsets
    if special:
        bounds = np.unique(np.concatenate([offsets, [p for s in special for p in s[:2]]]))
    starts, ends = cut_byte_level(buf, bounds)
    flagged = {s: i for s, _, i in special}
    hashes = tv.span_hash(tv.prefix_hash(buf), starts, ends)
    if special:
        begin, end = (np.array([s[k] for s in special]) for k in (0, 1))
        near = np.searchsorted(begin, starts, side="right") - 1
        inside = (near >= 0) & (starts < end[near])
        heads = np.array(sorted(flagged), np.int64)
        body_ids, body_count = cache.ids(buf, starts[~inside], ends[~inside], hashes[~inside])
        at = np.concatenate([starts[~inside], heads])
        order = np.argsort(at, kind="stable")
        count = np.concatenate([body_count, np.ones(len(heads), np.int64)])
        first = np.concatenate([np.cumsum(body_count) - body_count, len(body_ids) + np.arange(len(heads))])
        pool = np.concatenate([body_ids, np.array([flagged[h] for h in heads], np.int32)])
        ids, count, starts = pool[tv.expand(first[order], count[order])], count[order], at[order]
    else:
        ids, count = cache.ids(buf, starts, ends, hashes)
    total = np.concatenate([[0], np.cumsum(count)])
    edge = total[np.searchsorted(starts, offsets)]
    return ids, np.diff(edge)


def _special_spans(bpe: Bpe, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Begin, end and id of the special tokens' strings, none of which runs from one text into the next."""
    data = buf.tobytes()
    out = []
    for text, i in bpe.special.items():
        raw, at = text.encode(), 0
        while (at := data.find(raw, at)) >= 0:
            k = np.searchsorted(offsets, at, side="right")
            if k < len(offsets) and at + len(raw) > offsets[k]:
                at += 1
                continue
            out.append((at, at + len(raw), i))
            at += len(raw)
    return sorted(out)


def cut_word_level(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of each normalised text: runs of letters, single digits, runs of other signs; white space goes."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = tv.byte_classes(buf)
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    text_start = text_start[:n]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= text_start
    start |= (kind == tv.NUMBER) & ((buf & 0xC0) != 0x80)
    _contractions(buf, start, text_start)
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    solid = kind[starts] != tv.SPACE
    return starts[solid], ends[solid]


def normalise_words(text: str) -> str:
    """NFC, then lower case character by character."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def encode_normalised(cache: WordCache, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lower-case word-level BPE for all texts, one after the other, and each text's number of ids."""
    special = [s for s in cache.bpe.special]
    odd = {i for i, t in enumerate(texts) if "<|" in t and any(s in t for s in special)}
    plain = pa.array(["" if i in odd else normalise_words(t) for i, t in enumerate(texts)], pa.large_string())
    buf, offsets = tv.text_views(plain)
    starts, ends = cut_word_level(buf, offsets)
    ids, count = cache.ids(buf, starts, ends, tv.span_hash(tv.prefix_hash(buf), starts, ends))
    total = np.concatenate([[0], np.cumsum(count)])
    size = np.diff(total[np.searchsorted(starts, offsets)])
    if odd:
        cut, out = np.split(ids, np.cumsum(size)[:-1]), []
        pattern = "(" + "|".join(map(regex.escape, special)) + ")"
        for i, own in enumerate(cut):
            if i in odd:
                own = np.concatenate([np.array([cache.bpe.special[p]], np.int32) if p in cache.bpe.special else encode_normalised(cache, [p])[0] for p in regex.split(pattern, texts[i]) if p])
            out.append(own)
        ids, size = np.concatenate(out), np.array([len(x) for x in out], np.int64)
    return ids, size
