"""Fax coding of bitmaps: two-dimensional T.6 and the one-dimensional lines of T.4."""

from __future__ import annotations

import numpy as np

from bitloom.functions.huffman import Reader, Writer

_WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111
0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111
00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101
01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100""".split()
_WHITE_64 = """11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101
011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
_BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000
00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000
000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101
000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100
000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111""".split()
_BLACK_64 = """0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010
0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010
0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101""".split()
_FAR = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()


def _runs(short: list[str], long: list[str]) -> dict[int, str]:
    return dict(enumerate(short)) | {64 * (k + 1): c for k, c in enumerate(long)} | {1792 + 64 * k: c for k, c in enumerate(_FAR)}


RUNS = (_runs(_WHITE, _WHITE_64), _runs(_BLACK, _BLACK_64))
PASS, HORIZONTAL, END = "pass", "horizontal", "000000000001"
MODES = {"0001": PASS, "001": HORIZONTAL, "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
_MODE_CODES = {v: k for k, v in MODES.items()}


def _lookup(codes: dict[str, object], width: int) -> list[tuple[int, object] | None]:
    """By the next ``width`` bits: (length of the code, what it means)."""
    out: list = [None] * (1 << width)
    for code, what in codes.items():
        first = int(code, 2) << width - len(code)
        out[first : first + (1 << width - len(code))] = [(len(code), what)] * (1 << width - len(code))
    return out


_RUN_LOOKUP = tuple(_lookup({c: n for n, c in r.items()}, 13) for r in RUNS)
_MODE_LOOKUP = _lookup(MODES, 7)


class _Bits:
    """Looks ahead beyond the end, where there are zeros."""

    def __init__(self, data: bytes, at: int):
        self.data, self.bit, self.end = data, 8 * at, 8 * len(data)

    def peek(self, n: int) -> int:
        a = self.bit >> 3
        part = self.data[a : a + 5].ljust(5, b"\0")
        return int.from_bytes(part, "big") >> 40 - n - (self.bit & 7) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.bit += n
        if self.bit > self.end:
            raise ValueError("the fax data ends early")

    def run(self, colour: int) -> int:
        total = 0
        while True:
            got = _RUN_LOOKUP[colour][self.peek(13)]
            if got is None:
                raise ValueError("no such run")
            self.skip(got[0])
            total += got[1]
            if got[1] < 64:
                return total


def changes(row: np.ndarray) -> list[int]:
    """Where the colour changes, paper being on the left."""
    return np.flatnonzero(np.diff(row, prepend=np.uint8(0))).tolist()


def _reference(above: list[int], a0: int, colour: int, width: int, hint: int) -> tuple[int, int, int]:
    """b1, b2 and the place in ``above`` to begin the next search."""
    k = max(0, hint - 2)
    while k < len(above) and (above[k] <= a0 or k & 1 != colour):
        k += 1
    b1 = above[k] if k < len(above) else width
    return b1, above[k + 1] if k + 1 < len(above) else width, k


def _fill(at: list[int], width: int) -> np.ndarray:
    row = np.zeros(width + 1, np.int8)
    for k, x in enumerate(at):
        if x < width:
            row[x] += 1 - 2 * (k & 1)
    return np.cumsum(row[:width]).astype(np.uint8)


def decode(data: bytes, width: int, height: int, at: int = 0) -> tuple[np.ndarray, int]:
    """(bitmap, the byte after it and its end mark, if it has one)."""
    r = _Bits(data, at)
    out = np.zeros((height, width), np.uint8)
    above: list[int] = []
    for y in range(height):
        here: list[int] = []
        a0, colour, hint = -1, 0, 0
        while a0 < width:
            got = _MODE_LOOKUP[r.peek(7)]
            if got is None:
                raise ValueError("no such fax mode")
            r.skip(got[0])
            b1, b2, hint = _reference(above, a0, colour, width, hint)
            mode = got[1]
            if mode == PASS:
                a0 = b2
            elif mode == HORIZONTAL:
                start = max(a0, 0)
                for c in (colour, 1 - colour):
                    start = min(start + r.run(c), width)
                    here.append(start)
                a0 = start
                hint = 0 if a0 <= 0 else hint
            else:
                a0 = min(max(b1 + mode, 0), width)
                here.append(a0)
                colour ^= 1
                hint = max(0, hint - 2)
            if not width:
                break
        # runs of no length leave changes in pairs at one place
        out[y] = _fill(here, width)
        above = changes(out[y])
    if r.peek(24) == 0x1001:
        r.bit += 24
    return out, min(r.bit + 7 >> 3, len(data))


def encode(bitmap: np.ndarray, end: bool = True) -> bytes:
    w = Writer()
    height, width = bitmap.shape
    above: list[int] = []
    for y in range(height):
        here = changes(bitmap[y])
        a0, colour, hint, k = -1, 0, 0, 0
        while a0 < width:
            while k < len(here) and (here[k] <= a0 or k & 1 != colour):
                k += 1
            a1 = here[k] if k < len(here) else width
            a2 = here[k + 1] if k + 1 < len(here) else width
            b1, b2, hint = _reference(above, a0, colour, width, hint)
            if b2 < a1:
                _put(w, _MODE_CODES[PASS])
                a0 = b2
            elif abs(a1 - b1) <= 3:
                _put(w, _MODE_CODES[a1 - b1])
                a0, colour = a1, 1 - colour
                k, hint = max(0, k - 1), max(0, hint - 2)
            else:
                _put(w, _MODE_CODES[HORIZONTAL])
                _put_run(w, a1 - max(a0, 0), colour)
                _put_run(w, a2 - a1, 1 - colour)
                a0 = a2
            if not width:
                break
        above = here
    if end:
        _put(w, END + END)
    return w.finish()


def _put(w: Writer, code: str) -> None:
    w.bits(int(code, 2), len(code))


def _put_run(w: Writer, n: int, colour: int) -> None:
    while n >= 2560:
        _put(w, RUNS[colour][2560])
        n -= 2560
    if n >= 64:
        _put(w, RUNS[colour][n & ~63])
    _put(w, RUNS[colour][n & 63])


def encode_line(runs: list[int]) -> bytes:
    """One-dimensional: runs of paper and ink by turns, paper first."""
    w = Writer()
    for k, n in enumerate(runs):
        _put_run(w, n, k & 1)
    return w.finish()


def decode_line(data: bytes, width: int, at: int = 0) -> list[int]:
    r, out = _Bits(data, at), []
    while sum(out) < width:
        out.append(r.run(len(out) & 1))
    return out


__all__ = ["Reader", "changes", "decode", "decode_line", "encode", "encode_line"]
