"""The adaptive binary arithmetic coder of T.88 annex E, its integer procedures
(annex A), and a form of it that decodes many streams in step.

A context's state is one number, twice the row of the probability table plus the
more probable symbol, so a table lookup says all that happens to it.
"""

from __future__ import annotations

import numpy as np

_QE = "5601 3401 1801 0AC1 0521 0221 5601 5401 4801 3801 3001 2401 1C01 1601 5601 5401 5101 4801 3801 3401 3001 2801 2401 2201 1C01 1801 1601 1401 1201 1101 0AC1 09C1 08A1 0521 0441 02A1 0221 0141 0111 0085 0049 0025 0015 0009 0005 0001 5601"
QE = [int(x, 16) for x in _QE.split()]
NMPS = [1, 2, 3, 4, 5, 38, 7, 8, 9, 10, 11, 12, 13, 29, *range(15, 46), 45, 46]
NLPS = [1, 6, 9, 12, 29, 33, 6, 14, 14, 14, 17, 18, 20, 21, 14, 14, 15, 16, 17, 18, 19, 19, *range(20, 44), 46]
FLIP = {0, 6, 14}
Q = [q for q in QE for _ in range(2)]
Q16 = [q << 16 for q in Q]
MORE = [2 * NMPS[i] + m for i in range(47) for m in range(2)]
LESS = [2 * NLPS[i] + (1 - m if i in FLIP else m) for i in range(47) for m in range(2)]


class Decoder:
    """``bit(states, k)`` decodes a bit under the state ``states[k]``."""

    __slots__ = ("data", "at", "a", "c", "ct", "beyond")

    #: Bytes that may be asked for after the end; a whole stream needs a few.
    PATIENCE = 64

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.beyond = bytes(data[at:]) + b"\xff\xff", 0, 0
        self.c, self.ct = self.data[0] << 16, 0
        self.fill()
        self.c, self.ct, self.a = self.c << 7, self.ct - 7, 0x8000

    def fill(self) -> None:
        d, k = self.data, self.at
        if d[k] == 0xFF:
            if d[k + 1] > 0x8F:
                self.c += 0xFF00
                self.ct = 8
                self.beyond += 1
                if self.beyond > self.PATIENCE:
                    raise ValueError("the arithmetic-coded data ends early")
            else:
                self.at = k + 1
                self.c += d[k + 1] << 9
                self.ct = 7
        else:
            self.at = k + 1
            self.c += d[k + 1] << 8
            self.ct = 8

    def bit(self, states: bytearray, k: int) -> int:
        s = states[k]
        q = Q[s]
        a = self.a - q
        d = s & 1
        if self.c < Q16[s]:
            if a < q:
                states[k] = MORE[s]
            else:
                d = 1 - d
                states[k] = LESS[s]
            a = q
        else:
            self.c -= Q16[s]
            if a & 0x8000:
                self.a = a
                return d
            if a < q:
                d = 1 - d
                states[k] = LESS[s]
            else:
                states[k] = MORE[s]
        while True:
            if not self.ct:
                self.fill()
            a <<= 1
            self.c = self.c << 1 & 0xFFFFFFFF
            self.ct -= 1
            if a & 0x8000:
                self.a = a
                return d


class Encoder:
    __slots__ = ("out", "a", "c", "ct")

    def __init__(self) -> None:
        self.out, self.a, self.c, self.ct = bytearray([0]), 0x8000, 0, 12

    def _emit(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20 & 0xFF)
            self.c, self.ct = self.c & 0xFFFFF, 7
        else:
            self.out.append(self.c >> 19 & 0xFF)
            self.c, self.ct = self.c & 0x7FFFF, 8

    def bit(self, states: bytearray, k: int, d: int) -> None:
        s = states[k]
        q = Q[s]
        a = self.a - q
        if d == s & 1:
            if a & 0x8000:
                self.a = a
                self.c += q
                return
            if a < q:
                a = q
            else:
                self.c += q
            states[k] = MORE[s]
        else:
            if a < q:
                self.c += q
            else:
                a = q
            states[k] = LESS[s]
        while True:
            a <<= 1
            self.c <<= 1
            self.ct -= 1
            if not self.ct:
                self._emit()
            if a & 0x8000:
                self.a = a
                return

    def finish(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._emit()
        if self.out[-1] != 0xFF:
            self.out.append(0xFF)
        return bytes(self.out[1:]) + b"\xac"


# ---- integers ------------------------------------------------------------------------

#: (bits of the magnitude, its lowest value), by the number of leading ones.
RANGES = ((2, 0), (4, 4), (6, 20), (8, 84), (12, 340), (32, 4436))


def _next(prev: int, b: int) -> int:
    return prev << 1 | b if prev < 256 else ((prev << 1 | b) & 511) | 256


def decode_integer(dec: Decoder, states: bytearray) -> int | None:
    """A signed integer; None is the out-of-band value. ``states`` has 512 entries."""
    prev = 1

    def get() -> int:
        nonlocal prev
        b = dec.bit(states, prev)
        prev = _next(prev, b)
        return b

    sign, k = get(), 0
    while k < 5 and get():
        k += 1
    bits, low = RANGES[k]
    v = 0
    for _ in range(bits):
        v = v << 1 | get()
    v += low
    return v if not sign else -v if v else None


def encode_integer(enc: Encoder, states: bytearray, v: int | None) -> None:
    prev = 1

    def put(b: int) -> None:
        nonlocal prev
        enc.bit(states, prev, b)
        prev = _next(prev, b)

    put(int(v is None or v < 0))
    m = abs(v or 0)
    k = max(i for i, (_, low) in enumerate(RANGES) if m >= low)
    for i in range(5):
        if i == k:
            put(0)
            break
        put(1)
    bits, low = RANGES[k]
    for i in reversed(range(bits)):
        put(m - low >> i & 1)


def decode_id(dec: Decoder, states: bytearray, length: int) -> int:
    """A symbol number of ``length`` bits; ``states`` has 2 ** length entries."""
    prev = 1
    for _ in range(length):
        prev = prev << 1 | dec.bit(states, prev)
    return prev - (1 << length)


def encode_id(enc: Encoder, states: bytearray, length: int, v: int) -> None:
    prev = 1
    for i in reversed(range(length)):
        b = v >> i & 1
        enc.bit(states, prev, b)
        prev = prev << 1 | b


def code_length(n: int) -> int:
    """Bits that tell n symbols apart."""
    return max(0, n - 1).bit_length()


# ---- many streams in step ------------------------------------------------------------


class Flock:
    """Decoders of many streams, one bit of each at a time, with arrays."""

    _Q = np.array(Q, np.int64)
    _MORE, _LESS = np.array(MORE, np.uint8), np.array(LESS, np.uint8)

    def __init__(self, streams: list[bytes], contexts: int):
        n = len(streams)
        width = max(map(len, streams)) + 2
        self.data = np.full((n, width), 0xFF, np.int64)
        for i, s in enumerate(streams):
            self.data[i, : len(s)] = np.frombuffer(s, np.uint8)
        self.flat, self.base = self.data.ravel(), np.arange(n) * width
        self.last = width - 2
        self.at = np.zeros(n, np.int64)
        self.states = np.zeros(n * contexts, np.uint8)
        self.home = np.arange(n) * contexts
        self.ct, self.beyond = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.c = self.data[:, 0] << 16
        self.a = np.full(n, 0x8000, np.int64)
        self._fill(np.arange(n))
        self.c <<= 7
        self.ct -= 7

    def check(self, who: np.ndarray) -> None:
        """Refuses streams that ask for more after their end than whole ones need."""
        if (self.beyond[who] > Decoder.PATIENCE).any():
            raise ValueError("the arithmetic-coded data ends early")

    def _fill(self, who: np.ndarray) -> None:
        at = np.minimum(self.at[who], self.last)
        here, then = self.flat[self.base[who] + at], self.flat[self.base[who] + at + 1]
        marked = here == 0xFF
        ended = marked & (then > 0x8F)
        self.c[who] += np.where(ended, 0xFF00, np.where(marked, then << 9, then << 8))
        self.ct[who] = np.where(marked & ~ended, 7, 8)
        self.at[who] = at + ~ended
        self.beyond[who] += ended

    def bits(self, contexts: np.ndarray) -> np.ndarray:
        """The next bit of every stream."""
        k = self.home + contexts
        s = self.states[k]
        q = self._Q[s]
        a, high = self.a - q, q << 16
        low = self.c < high
        d = s & 1
        self.c -= np.where(low, 0, high)
        busy = np.flatnonzero(low | (a < 0x8000))
        if not len(busy):
            self.a = a
            return d
        qb, ab, lowb, sb = q[busy], a[busy], low[busy], s[busy]
        less = (ab < qb) != lowb
        d[busy] ^= less
        self.states[k[busy]] = np.where(less, self._LESS[sb], self._MORE[sb])
        a[busy] = np.where(lowb, qb, ab)
        while len(busy):
            dry = busy[self.ct[busy] == 0]
            if len(dry):
                self._fill(dry)
            # as many doublings as the byte at hand allows
            need = 16 - np.frexp(a[busy])[1]
            n = np.minimum(need, self.ct[busy])
            a[busy] <<= n
            self.c[busy] = self.c[busy] << n & 0xFFFFFFFF
            self.ct[busy] -= n
            busy = busy[n < need]
        self.a = a
        return d

    _OWN = ("base", "at", "home", "ct", "c", "a", "beyond")

    def part(self, who: np.ndarray) -> Flock:
        """Some of the streams, which share their states with the others."""
        out = object.__new__(Flock)
        out.flat, out.last, out.states = self.flat, self.last, self.states
        for f in self._OWN:
            setattr(out, f, getattr(self, f)[who])
        return out

    def back(self, who: np.ndarray, part: Flock) -> None:
        for f in self._OWN:
            getattr(self, f)[who] = getattr(part, f)


class FlockEncoder:
    """Encoders of many streams, a bit of each of the first ``len(d)`` at a time."""

    def __init__(self, n: int, contexts: int, most: int):
        #: A bit moves a stream by 15 doublings at most, and a byte takes 7 at least.
        self.width = 15 * most // 7 + 8
        self.out = np.zeros(n * self.width, np.uint8)
        self.at = np.arange(n) * self.width
        self.states = np.zeros(n * contexts, np.uint8)
        self.home = np.arange(n) * contexts
        self.a, self.c, self.ct = np.full(n, 0x8000, np.int64), np.zeros(n, np.int64), np.full(n, 12, np.int64)

    def _emit(self, who: np.ndarray) -> None:
        at, c = self.at[who], self.c[who]
        last = self.out[at]
        carry = (last != 0xFF) & (c >= 0x8000000)
        last += carry
        self.out[at] = last
        c = np.where(carry, c & 0x7FFFFFF, c)
        marked = last == 0xFF
        drop = np.where(marked, 20, 19)
        self.out[at + 1] = c >> drop & 0xFF
        self.at[who] = at + 1
        self.c[who] = c & (1 << drop) - 1
        self.ct[who] = np.where(marked, 7, 8)

    def bits(self, contexts: np.ndarray, d: np.ndarray) -> None:
        m = len(d)
        k = self.home[:m] + contexts
        s = self.states[k]
        q = Flock._Q[s]
        a = self.a[:m]
        a -= q
        hit = d == s & 1
        still = hit & (a >= 0x8000)
        self.c[:m] += np.where(still, q, 0)
        busy = np.flatnonzero(~still)
        if not len(busy):
            return
        ab, qb, sb, hb = a[busy], q[busy], s[busy], hit[busy]
        upper = (ab < qb) != hb  # the interval above the lesser one's
        self.c[busy] += np.where(upper, qb, 0)
        ab = np.where(upper, ab, qb)
        self.states[k[busy]] = np.where(hb, Flock._MORE[sb], Flock._LESS[sb])
        a[busy] = ab
        need = 16 - np.frexp(ab)[1]
        while len(busy):
            n = np.minimum(need, self.ct[busy])
            a[busy] <<= n
            self.c[busy] <<= n
            self.ct[busy] -= n
            dry = busy[self.ct[busy] == 0]
            if len(dry):
                self._emit(dry)
            need = need - n
            busy, need = busy[need > 0], need[need > 0]

    def finish(self) -> list[bytes]:
        top = self.c + self.a
        self.c |= 0xFFFF
        self.c -= np.where(self.c >= top, 0x8000, 0)
        every = np.arange(len(self.c))
        for _ in range(2):
            self.c <<= self.ct
            self._emit(every)
        begin, data = every * self.width + 1, self.out.tobytes()
        ended = self.out[self.at] == 0xFF
        return [data[a : b + 1] + (b"\xac" if e else b"\xff\xac") for a, b, e in zip(begin.tolist(), self.at.tolist(), ended.tolist())]


_BITS, _LOW = (np.array([x[k] for x in RANGES], np.int64) for k in range(2))
#: The automaton of an integer's bits. Phase 0 is the sign, k from 1 to 5 the prefix
#: after k - 1 ones; then those of the magnitude, by range and by bits still to come.
_PHASES = [(k, r) for k, (bits, _) in enumerate(RANGES) for r in range(bits, 0, -1)]
_NUMBER = {p: 6 + i for i, p in enumerate(_PHASES)}
_THEN = np.array(
    [[1, 1]]
    + [[_NUMBER[k, RANGES[k][0]], k + 2 if k < 4 else _NUMBER[5, 32]] for k in range(5)]
    + [[0 if r == 1 else _NUMBER[k, r - 1]] * 2 for k, r in _PHASES],
    np.int64,
)
_RANGE = np.array([0] * 6 + [k for k, _ in _PHASES], np.int64)


def _chains(v: np.ndarray, oob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bits of each integer, their number)."""
    m = np.where(oob, 0, np.abs(v))
    k = np.searchsorted(_LOW, m, "right") - 1
    ones = np.where(k < 5, (1 << k + 1) - 2, 31)
    sign = (oob | (v < 0)).astype(np.int64)
    prefix = np.minimum(k + 1, 5)
    return ((sign << prefix | ones) << _BITS[k]) | m - _LOW[k], 1 + prefix + _BITS[k]


def encode_integers(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Each stream's integers (``values`` cut at ``ends``), then the out-of-band value."""
    n = len(ends)
    if not n:
        return []
    count = np.diff(ends, prepend=0) + 1
    oob = np.zeros(len(values) + n, bool)
    oob[np.cumsum(count) - 1] = True
    v = np.zeros(len(oob), np.int64)
    v[~oob] = values
    if len(values) and np.abs(values).max() >= _LOW[-1] + (1 << 32):
        raise ValueError("an integer beyond the coder's reach")
    word, size = _chains(v, oob)
    after = np.cumsum(size)
    total = np.diff(after[np.cumsum(count) - 1], prepend=0)
    order = np.argsort(-total, kind="stable")
    begin = (np.cumsum(total) - total)[order]
    # every bit of all streams, and its context: the bits of the same integer before it
    which = np.repeat(np.arange(len(v)), size)
    place = np.arange(int(after[-1])) - (after - size)[which]
    left = size[which] - place
    w = word[which]
    bit = (w >> left - 1 & 1).astype(np.uint8)
    context = np.where(place < 9, 1 << np.minimum(place, 8), 256) | (w >> left) & (1 << np.minimum(place, 8)) - 1
    del which, place, left, w
    enc = FlockEncoder(n, 512, int(total.max()))
    live = n - np.searchsorted(np.sort(total), np.arange(int(total.max())), "right")
    for t, m in enumerate(live.tolist()):
        at = begin[:m] + t
        enc.bits(context[at], bit[at])
    out: list[bytes] = [b""] * n
    for k, data in zip(order.tolist(), enc.finish()):
        out[k] = data
    return out


def decode_integers(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the integers of all streams up to each one's out-of-band value, their ends)."""
    n = len(streams)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flock, who = Flock(streams, 512), np.arange(n)
    prev, phase, word = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live, steps = np.ones(n, bool), 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(who):
        b = flock.bits(prev).astype(np.int64)
        word = word << 1 | b
        prev = np.where(prev < 256, prev << 1 | b, (prev << 1 | b) & 511 | 256)
        then = _THEN[phase, b]
        done = np.flatnonzero(then == 0)
        if len(done):
            k = _RANGE[phase[done]]
            m = (word[done] & (1 << _BITS[k]) - 1) + _LOW[k]
            minus = word[done] >> _BITS[k] + np.minimum(k + 1, 5) & 1 == 1
            over = minus & (m == 0)
            keep = ~over & live[done]
            found.append((who[done[keep]], np.where(minus, -m, m)[keep]))
            live[done[over]] = False
            prev[done], word[done] = 1, 0
        phase, steps = then, steps + 1
        if not steps & 31 or 8 * live.sum() < 7 * len(live):
            flock.check(live)
            if not live.all():
                flock, who, prev, phase, word = flock.part(live), who[live], prev[live], phase[live], word[live]
                live = live[live]
    owner, v = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return v[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=n))
