"""Byte-level BPE pre-tokens, found with array operations.

Splits exactly as the public pattern of the byte-level vocabularies does:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

A batch of texts is one array of code points with a mark after each text; token
starts follow from the class of each code point and of its neighbours.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np

import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER, END = range(5)
_SPACES = {*range(9, 14), 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000} - {0x1C, 0x1D, 0x1E, 0x1F}


def _class_of(cp: int) -> int:
    if cp in _SPACES:
        return SPACE
    c = unicodedata.category(chr(cp))[0]
    return {"L": LETTER, "N": NUMBER}.get(c, OTHER)


@lru_cache(1)
def _table() -> np.ndarray:
    t = np.full(0x110000, 255, np.uint8)
    t[:0x3001] = [_class_of(i) for i in range(0x3001)]
    return t


def _classes(cps: np.ndarray) -> np.ndarray:
    t = _table()
    k = t[cps]
    if (k == 255).any():
        for cp in np.unique(cps[k == 255]):
            t[cp] = _class_of(int(cp))
        k = t[cps]
    return k


class Batch:
    """Pre-tokens of a list of texts as byte ranges of one buffer.

    data: UTF-8 of all texts, one zero byte after each; s, e: ranges; doc: the
    position of each pre-token's text."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        joined = "\0".join(texts) + "\0" if texts else ""
        self.data = joined.encode("utf-8", "surrogatepass")
        self.b = np.frombuffer(self.data, np.uint8)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
        k = _classes(cps)
        k[ends] = END
        n = len(k)
        prev = np.full(n, END, np.uint8)
        prev[1:] = k[:-1]
        nxt = np.full(n, END, np.uint8)
        nxt[:-1] = k[1:]
        start = k != prev
        plain = cps == 32
        word = (nxt == LETTER) | (nxt == NUMBER) | (nxt == OTHER)
        # the last of several spaces stands alone, or leads the word if it is U+0020
        last = (k == SPACE) & word
        start |= last
        lead = last & plain
        after = np.zeros(n, bool)
        after[1:] = lead[:-1]
        start &= ~after
        self._contractions(cps, k, start)
        at = np.flatnonzero(start & (k != END))
        # ranges end at the next start or at the text's mark
        stops = np.flatnonzero(start | (k == END))
        e = stops[np.searchsorted(stops, at, "right")]
        width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
        byte = np.concatenate(([0], np.cumsum(width)))
        self.s, self.e = byte[at], byte[e]
        self.marks = byte[ends]
        self.plain = self.data.count(b"\0") == len(texts)
        self.doc = np.searchsorted(ends, at)
        self.n_texts = len(texts)

    @staticmethod
    def _contractions(cps: np.ndarray, k: np.ndarray, start: np.ndarray) -> None:
        quotes = np.flatnonzero((cps == 39) & start & (k == OTHER))
        if not len(quotes):
            return
        pad = np.concatenate([cps, [0, 0, 0]])
        a, b = pad[quotes + 1], pad[quotes + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        n = len(start)
        for length, q in ((2, quotes[one]), (3, quotes[two])):
            start[q + 1] = False
            end = q + length
            end = end[end < n]
            start[end] = True

    def words(self) -> pa.DictionaryArray:
        """The pre-tokens as indices into their distinct values, found by
        comparing bytes."""
        # pre-tokens cover their texts, so without the marks they are contiguous
        data = pa.py_buffer(self.data.replace(b"\0", b"")) if self.plain else pa.py_buffer(self.b[self.unmarked()].tobytes())
        offsets = np.append(self.s - self.doc, len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.s), [None, pa.py_buffer(offsets), data]).dictionary_encode()

    def unmarked(self) -> np.ndarray:
        keep = np.ones(len(self.b), bool)
        keep[self.marks] = False
        return keep


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair encoding of one pre-token: the lowest-ranked adjacent pair is
    merged, leftmost first, until no pair is in the vocabulary."""
    whole = ranks.get(word)
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if whole is not None and len(parts) == 1:
            return [whole]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, for words of any length in O(n log n)."""
    import heapq

    n = len(parts)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n:
            r = ranks.get(parts[i] + parts[j])
            if r is not None:
                heapq.heappush(heap, (r, i, len(parts[i]), len(parts[j])))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or len(parts[i]) != a or len(parts[j]) != b:
            continue
        parts[i] += parts[j]
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    return [ranks[parts[i]] for i in range(n) if alive[i]]


class Merger:
    """The merge rules over many pre-tokens at once, with arrays.

    Every way to cut a vocabulary string into two others is one entry of a hash
    table from a pair of ids to the id of the whole, so one round looks up the
    pairs of all words together and merges each word's lowest, leftmost one.
    """

    _NONE = np.int64(1 << 40)
    _LONG = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(ranks[w[:i]] << 20 | ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks]
        keys, values = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        self.bits = max(8, int(np.ceil(np.log2(4 * len(pairs) + 1))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self._NONE, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # one key settles in each free slot, the others move on
            free = self.keys[at[left]] == -1
            self.keys[at[left[free]]] = keys[left[free]]
            settled = self.keys[at[left]] == keys[left]
            self.values[at[left[settled]]] = values[left[settled]]
            left = left[~settled]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, or _NONE."""
        key = a << 20 | b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], self._NONE)
        left = np.flatnonzero((found != key) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, end of each word's ids)."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        size = np.diff(offsets)
        word = np.repeat(np.arange(n), size)
        ids = self.byte[data]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if (size > self._LONG).any():
            for i in np.flatnonzero(size > self._LONG).tolist():
                own = np.array(merge_word(words[i].as_py(), self.ranks), np.int64)
                done.append((np.full(len(own), i), own))
            short = size[word] <= self._LONG
            word, ids = word[short], ids[short]
        rank = np.full(len(ids), self._NONE, np.int64)
        if len(ids) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self._pair(ids[:-1], ids[1:]), self._NONE)
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(ids)))
            if (over := least == self._NONE).any():
                gone = np.repeat(over, length)
                done.append((word[gone], ids[gone]))
                word, ids, rank = word[~gone], ids[~gone], rank[~gone]
                least, length = least[~over], length[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, length))
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # places after the removal: one entry left each earlier word
            word, ids, rank = word[keep], ids[keep], rank[keep]
            for p in (at, at[at > 0] - 1):
                q = np.minimum(p + 1, len(ids) - 1)
                rank[p] = np.where((q > p) & (word[q] == word[p]), self._pair(ids[p], ids[q]), self._NONE)
        if not done:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        word, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(word, kind="stable")], np.cumsum(np.bincount(word, minlength=n))
