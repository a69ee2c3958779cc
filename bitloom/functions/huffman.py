"""Huffman tables of T.88 annex B: the fifteen standard ones, tables sent in a stream,
and bit readers and writers."""

from __future__ import annotations

from functools import cached_property, lru_cache

import numpy as np

OOB, LOWER, UPPER = "oob", "lower", "upper"
#: Lines ``prefix length, range length, lowest value``; L and U are open ranges, O is
#: the out-of-band line.
_STANDARD = {
    1: "1,4,0 2,8,16 3,16,272 U3,65808",
    2: "1,0,0 2,0,1 3,0,2 4,3,3 5,6,11 U6,75 O6",
    3: "8,8,-256 1,0,0 2,0,1 3,0,2 4,3,3 5,6,11 L8,-257 U7,75 O6",
    4: "1,0,1 2,0,2 3,0,3 4,3,4 5,6,12 U5,76",
    5: "7,8,-255 1,0,1 2,0,2 3,0,3 4,3,4 5,6,12 L7,-256 U6,76",
    6: "5,10,-2048 4,9,-1024 4,8,-512 4,7,-256 5,6,-128 5,5,-64 4,5,-32 2,7,0 3,7,128 3,8,256 4,9,512 4,10,1024 L6,-2049 U6,2048",
    7: "4,9,-1024 3,8,-512 4,7,-256 5,6,-128 5,5,-64 4,5,-32 4,5,0 5,5,32 5,6,64 4,7,128 3,8,256 3,9,512 3,10,1024 L5,-1025 U5,2048",
    8: "8,3,-15 9,1,-7 8,1,-5 9,0,-3 7,0,-2 4,0,-1 2,1,0 5,0,2 6,0,3 3,4,4 6,1,20 4,4,22 4,5,38 5,6,70 5,7,134 6,7,262 7,8,390 6,10,646 L9,-16 U9,1670 O2",
    9: "8,4,-31 9,2,-15 8,2,-11 9,1,-7 7,1,-5 4,1,-3 3,1,-1 3,1,1 5,1,3 6,1,5 3,5,7 6,2,39 4,5,43 4,6,75 5,7,139 5,8,267 6,8,523 7,9,779 6,11,1291 L9,-32 U9,3339 O2",
    10: "7,4,-21 8,0,-5 7,0,-4 5,0,-3 2,2,-2 5,0,2 6,0,3 7,0,4 8,0,5 2,6,6 5,5,70 6,5,102 6,6,134 6,7,198 6,8,326 6,9,582 6,10,1094 7,11,2118 L8,-22 U8,4166 O2",
    11: "1,0,1 2,1,2 4,0,4 4,1,5 5,1,7 5,2,9 6,2,13 7,2,17 7,3,21 7,4,29 7,5,45 7,6,77 U7,141",
    12: "1,0,1 2,0,2 3,1,3 5,0,5 5,1,6 6,1,8 7,0,10 7,1,11 7,2,13 7,3,17 7,4,25 8,5,41 U8,73",
    13: "1,0,1 3,0,2 4,0,3 5,0,4 4,1,5 3,3,7 6,1,15 6,2,17 6,3,21 6,4,29 6,5,45 7,6,77 U7,141",
    14: "3,0,-2 3,0,-1 1,0,0 3,0,1 3,0,2",
    15: "7,4,-24 6,2,-8 5,1,-4 4,0,-2 3,0,-1 1,0,0 3,0,1 4,0,2 5,1,3 6,2,5 7,4,9 L7,-25 U7,25",
}


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.bit = data, 8 * at

    def bits(self, n: int) -> int:
        end = self.bit + n
        if end > 8 * len(self.data):
            raise ValueError("the Huffman data ends early")
        part = int.from_bytes(self.data[self.bit >> 3 : end + 7 >> 3], "big")
        self.bit, out = end, part >> (-end & 7) & ((1 << n) - 1)
        return out

    def align(self) -> int:
        self.bit = self.bit + 7 & ~7
        return self.bit >> 3

    def take(self, n: int) -> bytes:
        at = self.align()
        if at + n > len(self.data):
            raise ValueError("the Huffman data ends early")
        self.bit += 8 * n
        return self.data[at : at + n]


class Writer:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0

    def bits(self, v: int, n: int) -> None:
        if n:
            self.parts.append(format(v & ((1 << n) - 1), f"0{n}b"))
            self.size += n

    def align(self) -> None:
        self.bits(0, -self.size & 7)

    def add(self, data: bytes) -> None:
        self.align()
        for b in data:
            self.bits(b, 8)

    def finish(self) -> bytes:
        self.align()
        s = "".join(self.parts)
        return int(s, 2).to_bytes(len(s) // 8, "big") if s else b""


def canonical(lengths: list[int]) -> list[int]:
    """Codes of the given lengths: shorter ones first, in order within a length; a
    length of 0 has no code."""
    out, code = [0] * len(lengths), 0
    for n in range(1, max(lengths, default=0) + 1):
        code <<= 1
        for k, x in enumerate(lengths):
            if x == n:
                out[k] = code
                code += 1
        if code > 1 << n:
            raise ValueError("more codes than a prefix code has")
    return out


class Table:
    """Lines (kind, prefix length, range length, lowest value)."""

    def __init__(self, lines: list[tuple[str, int, int, int]]):
        self.lines = lines
        codes = canonical([x[1] for x in lines])
        self.code = {(x[1], c): k for k, (x, c) in enumerate(zip(lines, codes)) if x[1]}
        self.codes = codes
        self.longest = max((x[1] for x in lines), default=0)

    @cached_property
    def columns(self) -> Columns:
        return Columns(self)

    def decode(self, r: Reader) -> int | None:
        code = 0
        for n in range(1, self.longest + 1):
            code = code << 1 | r.bits(1)
            k = self.code.get((n, code))
            if k is not None:
                kind, _, size, low = self.lines[k]
                if kind == OOB:
                    return None
                extra = r.bits(size)
                return low - extra if kind == LOWER else low + extra
        raise ValueError("no such Huffman code")

    def encode(self, w: Writer, v: int | None) -> None:
        for (kind, n, size, low), code in zip(self.lines, self.codes):
            if not n:
                continue
            if kind == OOB:
                hit, rest = v is None, 0
            elif v is None:
                continue
            else:
                rest = low - v if kind == LOWER else v - low
                hit = 0 <= rest < 1 << size
            if hit:
                w.bits(code, n)
                w.bits(rest, size if kind != OOB else 0)
                return
        raise ValueError(f"the table has no code for {v}")


class Columns:
    """A table's codes for whole columns: each value is a stream of its own, filled up
    to whole bytes. What takes an operation a line or a bit in ``Table`` is a lookup."""

    def __init__(self, table: Table):
        lines = [(kind, n, size, low, code) for (kind, n, size, low), code in zip(table.lines, table.codes) if n]
        self.n, self.size, self.low, self.code = (np.array([x[k] for x in lines], np.int64) for k in (1, 2, 3, 4))
        self.sign = np.array([-1 if x[0] == LOWER else 1 for x in lines], np.int64)
        self.oob = np.array([x[0] == OOB for x in lines], bool)
        self.longest = table.longest
        if (self.n + self.size).max(initial=0) > 64:
            raise ValueError("a code of more than 64 bits")
        # where the line of a value may change, and the first line from there on that has it
        first = np.where(self.sign < 0, self.low - (1 << self.size) + 1, self.low)[~self.oob]
        after = first + (1 << self.size[~self.oob])
        self.breaks = np.unique(np.concatenate([first, after]))
        own = np.flatnonzero(~self.oob)
        self.line = np.array([next((int(own[k]) for k in range(len(own)) if first[k] <= x < after[k]), -1) for x in self.breaks], np.int64)
        # the line of every possible beginning of a stream
        self.begin = np.full(1 << self.longest, -1)
        for k, (n, code) in enumerate(zip(self.n.tolist(), self.code.tolist())):
            self.begin[code << self.longest - n : code + 1 << self.longest - n] = k

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes, end of each value's)."""
        at = np.searchsorted(self.breaks, v, "right") - 1
        k = np.where(at < 0, -1, self.line[at])
        if (k < 0).any():
            raise ValueError(f"the table has no code for {v[k < 0][0]}")
        bits = self.n[k] + self.size[k]
        rest = np.where(self.sign[k] < 0, self.low[k] - v, v - self.low[k])
        word = ((self.code[k] << self.size[k] | rest) << 64 - bits).astype(">i8")
        size = bits + 7 >> 3
        return word.view(np.uint8).reshape(-1, 8)[np.arange(8) < size[:, None]], np.cumsum(size)

    def decode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether they are out of band) of streams as ``encode`` makes them."""
        size = np.diff(ends, prepend=0)
        place = np.arange(8)
        at = (ends - size)[:, None] + place
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        word = np.where(place < size[:, None], padded[np.minimum(at, len(data))], 0).astype(np.uint8).view(">u8").ravel().astype(np.uint64)
        k = self.begin[(word >> np.uint64(64 - self.longest)).astype(np.int64)]
        if (k < 0).any():
            raise ValueError("no such Huffman code")
        bits = self.n[k] + self.size[k]
        if (bits > 8 * size).any():
            raise ValueError("the Huffman data ends early")
        extra = (word >> (64 - bits).astype(np.uint64)).astype(np.int64) & (1 << self.size[k]) - 1
        return self.low[k] + self.sign[k] * extra, self.oob[k]


def _line(text: str) -> tuple[str, int, int, int]:
    if text[0] == "O":
        return OOB, int(text[1:]), 0, 0
    if text[0] in "LU":
        n, low = text[1:].split(",")
        return LOWER if text[0] == "L" else UPPER, int(n), 32, int(low)
    n, size, low = map(int, text.split(","))
    return "", n, size, low


@lru_cache
def standard(number: int) -> Table:
    return Table([_line(x) for x in _STANDARD[number].split()])


def sent(body: bytes) -> Table:
    """The table of a tables segment (B.2)."""
    flags = body[0]
    low, high = (int.from_bytes(body[k : k + 4], "big", signed=True) for k in (1, 5))
    r = Reader(body, 9)
    prefix, size = (flags >> 1 & 7) + 1, (flags >> 4 & 7) + 1
    lines, at = [], low
    while at < high:
        n, k = r.bits(prefix), r.bits(size)
        lines.append(("", n, k, at))
        at += 1 << k
    lines.append((LOWER, r.bits(prefix), 32, low - 1))
    lines.append((UPPER, r.bits(prefix), 32, at))
    if flags & 1:
        lines.append((OOB, r.bits(prefix), 0, 0))
    return Table(lines)


def send(low: int, lines: list[tuple[int, int]], below: int, above: int, oob: int | None = None) -> bytes:
    """A tables segment's body: (prefix length, range length) of each line from ``low``
    on, and the prefix lengths of the open ranges and of the out-of-band line."""
    prefix = max(1, max([below, above, oob or 0, *(n for n, _ in lines)]).bit_length())
    size = max(1, max((k for _, k in lines), default=0).bit_length())
    high = low + sum(1 << k for _, k in lines)
    w = Writer()
    for n, k in lines:
        w.bits(n, prefix)
        w.bits(k, size)
    for n in (below, above, *([] if oob is None else [oob])):
        w.bits(n, prefix)
    flags = int(oob is not None) | prefix - 1 << 1 | size - 1 << 4
    return bytes([flags]) + low.to_bytes(4, "big", signed=True) + high.to_bytes(4, "big", signed=True) + w.finish()


#: The codes of code lengths in a text region: literal lengths, then the repeats.
def read_id_codes(r: Reader, n: int) -> Table:
    """The symbol codes of a Huffman text region (7.4.3.1.7)."""
    runs = Table([("", r.bits(4), 0, k) for k in range(35)])
    lengths: list[int] = []
    while len(lengths) < n:
        k = runs.decode(r)
        if k < 32:
            lengths.append(k)
        elif k == 32:
            if not lengths:
                raise ValueError("nothing to repeat")
            lengths += [lengths[-1]] * (r.bits(2) + 3)
        elif k == 33:
            lengths += [0] * (r.bits(3) + 3)
        else:
            lengths += [0] * (r.bits(7) + 11)
    r.align()
    return Table([("", x, 0, k) for k, x in enumerate(lengths[:n])])


def write_id_codes(w: Writer, n: int) -> Table:
    """Codes of equal length for n symbols."""
    size = max(1, (n - 1).bit_length())
    for k in range(35):
        w.bits(int(k == size), 4)
    runs = Table([("", int(k == size), 0, k) for k in range(35)])
    for _ in range(n):
        runs.encode(w, size)
    w.align()
    return Table([("", size, 0, k) for k in range(n)])
