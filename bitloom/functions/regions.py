"""Generic, refinement, pattern and halftone coding (T.88 6.2, 6.3, 6.6, 6.7).

A bitmap is an array of rows of 0 and 1. Contexts are formed by rows: what lies above
is one array operation for the whole row, and the loop over pixels only adds those to
the left.
"""

from __future__ import annotations

import numpy as np

from bitloom.functions import mq
from bitloom.functions.mq import LESS, MORE, Q, Q16

#: By template: pixels as (dx, dy), lowest context bit first; None stands for the next
#: adaptive pixel.
TEMPLATES = {
    0: [(-1, 0), (-2, 0), (-3, 0), (-4, 0), None, (2, -1), (1, -1), (0, -1), (-1, -1), (-2, -1), None, None, (1, -2), (0, -2), (-1, -2), None],
    1: [(-1, 0), (-2, 0), (-3, 0), None, (2, -1), (1, -1), (0, -1), (-1, -1), (-2, -1), (2, -2), (1, -2), (0, -2), (-1, -2)],
    2: [(-1, 0), (-2, 0), None, (1, -1), (0, -1), (-1, -1), (-2, -1), (1, -2), (0, -2), (-1, -2)],
    3: [(-1, 0), (-2, 0), (-3, 0), (-4, 0), None, (1, -1), (0, -1), (-1, -1), (-2, -1), (-3, -1)],
}
NOMINAL = {0: ((3, -1), (-3, -1), (2, -2), (-2, -2)), 1: ((3, -1),), 2: ((2, -1),), 3: ((2, -1),)}
#: The extended template 0: four fixed pixels and twelve adaptive ones.
EXTENDED = [(-1, 0), None, None, None, None, None, (1, -1), (0, -1), (-1, -1), None, None, None, None, None, None, None]
EXTENDED_AT = ((-2, 0), (-3, 0), (-4, 0), (3, -1), (2, -1), (-2, -1), (-3, -1), (2, -2), (1, -2), (0, -2), (-1, -2), (-2, -2))
TYPICAL = {0: 0x9B25, 1: 0x0795, 2: 0x00E5, 3: 0x0195}


def pixels(template: int, at=None, extended: bool = False) -> list[tuple[int, int]]:
    layout = EXTENDED if extended else TEMPLATES[template]
    spots = list(at if at is not None else EXTENDED_AT if extended else NOMINAL[template])
    if len(spots) != layout.count(None) or any(dy > 0 or (dy == 0 and dx >= 0) for dx, dy in spots):
        raise ValueError("adaptive pixels must come before the pixel itself")
    return [p if p is not None else spots.pop(0) for p in layout]


def contexts_of(template: int) -> int:
    return 1 << len(TEMPLATES[template])


#: Pixels of a row, and of the window of a context, up to which rows are products.
_NARROW = 128
#: Pixels whose contexts are formed at once when all rows are known.
_BAND = 1 << 14


class Rows:
    """A bitmap under construction, with paper around it, and the part of each
    context that rows above give."""

    def __init__(self, width: int, height: int, shape: list[tuple[int, int]], flock: int = 0):
        self.left = max(4, *(-dx for dx, _ in shape))
        self.up = max(2, *(-dy for _, dy in shape))
        right = max(4, *(dx for dx, _ in shape))
        lead = (flock,) if flock else ()
        self.all = np.zeros((*lead, height + self.up, width + self.left + right), np.uint8)
        self.width = width
        self.shape = list(enumerate(shape))
        self.above_part = [(k, dx, dy) for k, (dx, dy) in self.shape if dy]
        # the pixels just left of this one are a shift register: bit k is dx = -1 - k
        self.near = 0
        while (self.near, (-1 - self.near, 0)) in self.shape:
            self.near += 1
        self.far = [(k, dx) for k, (dx, dy) in self.shape if dy == 0 and k >= self.near]
        # of one narrow bitmap, a row's contexts are one product: a call costs more than its pixels
        self.windows = None
        high, wide = max((-dy for _, _, dy in self.above_part), default=0), self.left + right + 1
        if not flock and 0 < width <= _NARROW and high * wide <= _NARROW:
            weights = np.zeros((high, wide), np.int32)
            for k, dx, dy in self.above_part:
                weights[high + dy, self.left + dx] += 1 << k
            stride, step = self.all.strides
            self.windows = np.lib.stride_tricks.as_strided(self.all[self.up - high :], (height, width, high, wide), (stride, step, stride, step))
            self.weights = weights.ravel()

    def above(self, y: int) -> np.ndarray:
        if self.windows is not None:
            return self.windows[y].reshape(self.width, -1).astype(np.int32) @ self.weights
        out = np.zeros((*self.all.shape[:-2], self.width), np.int64)
        for k, dx, dy in self.above_part:
            a = self.left + dx
            out |= self.all[..., y + self.up + dy, a : a + self.width].astype(np.int64) << k
        return out

    def band(self, y: int, h: int) -> np.ndarray:
        """The contexts of ``h`` finished rows' pixels."""
        out = np.zeros((h, self.width), np.int64)
        for k, (dx, dy) in self.shape:
            top, a = y + self.up + dy, self.left + dx
            out |= self.all[top : top + h, a : a + self.width].astype(np.int64) << k
        return out

    def row(self, y: int) -> np.ndarray:
        return self.all[..., y + self.up, self.left : self.left + self.width]

    @property
    def bitmap(self) -> np.ndarray:
        return self.all[..., self.up :, self.left : self.left + self.width]


def decode_generic(dec: mq.Decoder, width: int, height: int, template: int = 0, at=None, typical: bool = False, states: bytearray | None = None, skip: np.ndarray | None = None, extended: bool = False) -> np.ndarray:
    rows = Rows(width, height, pixels(template, at, extended))
    states = states if states is not None else bytearray(contexts_of(template))
    same = 0
    mask = (1 << rows.near) - 1
    for y in range(height):
        if typical:
            same ^= dec.bit(states, TYPICAL[template])
            if same:
                if y:
                    rows.row(y)[:] = rows.row(y - 1)
                continue
        above = rows.above(y).tolist()
        if rows.far or skip is not None:
            line = rows.all[y + rows.up]
            cur = 0
            for x in range(width):
                k = above[x] | cur
                for bit, dx in rows.far:
                    k |= int(line[x + rows.left + dx]) << bit
                b = 0 if skip is not None and skip[y, x] else dec.bit(states, k)
                line[x + rows.left] = b
                cur = (cur << 1 | b) & mask
        else:
            rows.row(y)[:] = _row(dec, states, above, mask)
    return rows.bitmap.copy()


def _row(dec: mq.Decoder, states: bytearray, above: list[int], mask: int) -> list[int]:
    """A row of bits, the decoder's registers being local."""
    a, c, ct = dec.a, dec.c, dec.ct
    cur, out = 0, []
    put, q16, qs = out.append, Q16, Q
    for up in above:
        k = up | cur
        s = states[k]
        high = q16[s]
        a -= qs[s]
        d = s & 1
        if c >= high:
            c -= high
            if a & 0x8000:
                put(d)
                cur = (cur << 1 | d) & mask
                continue
            if a < qs[s]:
                d = 1 - d
                states[k] = LESS[s]
            else:
                states[k] = MORE[s]
        else:
            if a < qs[s]:
                states[k] = MORE[s]
            else:
                d = 1 - d
                states[k] = LESS[s]
            a = qs[s]
        while True:
            if not ct:
                dec.c = c
                dec.fill()
                c, ct = dec.c, dec.ct
            a <<= 1
            c = c << 1 & 0xFFFFFFFF
            ct -= 1
            if a & 0x8000:
                break
        put(d)
        cur = (cur << 1 | d) & mask
    dec.a, dec.c, dec.ct = a, c, ct
    return out


def encode_generic(enc: mq.Encoder, bitmap: np.ndarray, template: int = 0, at=None, typical: bool = False, states: bytearray | None = None, skip: np.ndarray | None = None, extended: bool = False) -> None:
    height, width = bitmap.shape
    rows = Rows(width, height, pixels(template, at, extended))
    rows.bitmap[:] = bitmap
    states = states if states is not None else bytearray(contexts_of(template))
    same = False
    band = max(1, _BAND // max(width, 1))
    for y in range(height):
        if not y % band:
            h = min(band, height - y)
            contexts, lines = rows.band(y, h).tolist(), bitmap[y : y + h].tolist()
            above = rows.all[y + rows.up - 1 : y + rows.up - 1 + h, rows.left : rows.left + width]
            repeats = (bitmap[y : y + h] == above).all(axis=1).tolist()
        at = y % band
        if typical:
            now = repeats[at]
            enc.bit(states, TYPICAL[template], int(now != same))
            same = now
            if same:
                continue
        for x, (ctx, b) in enumerate(zip(contexts[at], lines[at])):
            if skip is None or not skip[y, x]:
                enc.bit(states, ctx, b)


def decode_many(streams: list[bytes], width: int, height: int, template: int = 0, at=None, typical: bool = False) -> np.ndarray:
    """Regions of one size, decoded in step: pixel by pixel, but all regions at once.

    An adaptive pixel of the same row makes no difference to the result."""
    rows = Rows(width, height, pixels(template, at), len(streams))
    flock = mq.Flock(streams, contexts_of(template))
    mask = (1 << rows.near) - 1
    same = np.zeros(len(streams), np.int64)
    for y in range(height):
        if typical:
            same ^= flock.bits(np.full(len(streams), TYPICAL[template]))
        above = rows.above(y)
        line = rows.all[:, y + rows.up]
        cur = np.zeros(len(streams), np.int64)
        wait = same.any()
        if wait:  # streams whose row repeats stand still
            rows.row(y)[same == 1] = rows.row(y - 1)[same == 1] if y else 0
            going = np.flatnonzero(same == 0)
            if not len(going):
                continue
            part = flock.part(going)
            cur = cur[going]
        else:
            going, part = None, flock
        for x in range(width):
            k = (above[:, x] if going is None else above[going, x]) | cur
            for bit, dx in rows.far:
                k |= (line[:, x + rows.left + dx] if going is None else line[going, x + rows.left + dx]).astype(np.int64) << bit
            b = part.bits(k)
            if going is None:
                line[:, x + rows.left] = b
            else:
                line[going, x + rows.left] = b
            cur = (cur << 1 | b) & mask
        if going is not None:
            flock.back(going, part)
    return rows.bitmap.copy()


# ---- refinement ----------------------------------------------------------------------

#: By template: pixels of the new bitmap, then of the reference, lowest bit first.
REFINING = {
    0: ([(-1, 0), (1, -1), (0, -1), None], [(1, 1), (0, 1), (-1, 1), (1, 0), (0, 0), (-1, 0), (1, -1), (0, -1), None]),
    1: ([(-1, 0), (1, -1), (0, -1), (-1, -1)], [(1, 1), (0, 1), (1, 0), (0, 0), (-1, 0), (0, -1)]),
}
REFINE_AT = ((-1, -1), (-1, -1))
REFINE_TYPICAL = {0: 0x0100, 1: 0x0080}


def _shifted(reference: np.ndarray, width: int, height: int, dx: int, dy: int) -> np.ndarray:
    """out[y, x] = reference[y - dy, x - dx], paper outside."""
    out = np.zeros((height, width), np.uint8)
    h, w = reference.shape
    y0, y1, x0, x1 = max(0, dy), min(height, h + dy), max(0, dx), min(width, w + dx)
    if y1 > y0 and x1 > x0:
        out[y0:y1, x0:x1] = reference[y0 - dy : y1 - dy, x0 - dx : x1 - dx]
    return out


class _Refiner:
    def __init__(self, width: int, height: int, reference: np.ndarray, dx: int, dy: int, template: int, at):
        mine, theirs = REFINING[template]
        spots = list(at or REFINE_AT)
        self.mine = [p if p is not None else spots[0] for p in mine]
        theirs = [p if p is not None else spots[1] for p in theirs]
        self.part = np.zeros((height, width), np.int64)
        for k, (x, y) in enumerate(theirs):
            self.part |= _shifted(reference, width, height, dx - x, dy - y).astype(np.int64) << (len(mine) + k)
        around = sum(_shifted(reference, width, height, dx - x, dy - y).astype(np.int64) for x in (-1, 0, 1) for y in (-1, 0, 1))
        #: What a typical pixel is: the value of nine equal reference pixels, else 2.
        self.typical = np.where(around == 9, 1, np.where(around == 0, 0, 2))
        self.rows = Rows(width, height, self.mine)


def decode_refinement(dec: mq.Decoder, width: int, height: int, reference: np.ndarray, dx: int = 0, dy: int = 0, template: int = 0, at=None, typical: bool = False, states: bytearray | None = None) -> np.ndarray:
    r = _Refiner(width, height, reference, dx, dy, template, at)
    states = states if states is not None else bytearray(1 << 13)
    on = 0
    rows = r.rows
    for y in range(height):
        if typical:
            on ^= dec.bit(states, REFINE_TYPICAL[template])
        above = (rows.above(y) | r.part[y]).tolist()
        sure = r.typical[y].tolist() if on else None
        line = rows.all[y + rows.up]
        cur = 0
        for x in range(width):
            if sure is not None and sure[x] < 2:
                b = sure[x]
            else:
                k = above[x] | cur
                for bit, d in rows.far:
                    k |= int(line[x + rows.left + d]) << bit
                b = dec.bit(states, k)
            line[x + rows.left] = b
            cur = b
    return rows.bitmap.copy()


def encode_refinement(enc: mq.Encoder, bitmap: np.ndarray, reference: np.ndarray, dx: int = 0, dy: int = 0, template: int = 0, at=None, typical: bool = False, states: bytearray | None = None) -> None:
    height, width = bitmap.shape
    r = _Refiner(width, height, reference, dx, dy, template, at)
    states = states if states is not None else bytearray(1 << 13)
    on = False
    rows = r.rows
    rows.bitmap[:] = bitmap
    for y in range(height):
        sure = r.typical[y]
        if typical:
            now = bool(((sure == 2) | (sure == bitmap[y])).all())
            enc.bit(states, REFINE_TYPICAL[template], int(now != on))
            on = now
        k = rows.above(y) | r.part[y]
        line = rows.all[y + rows.up]
        for bit, (x, dy_) in rows.shape:
            if dy_ == 0:
                k |= line[rows.left + x : rows.left + x + width].astype(np.int64) << bit
        for x, (ctx, b) in enumerate(zip(k.tolist(), bitmap[y].tolist())):
            if not (on and sure[x] < 2):
                enc.bit(states, ctx, b)


# ---- patterns and halftones ----------------------------------------------------------


def _pattern_at(template: int, width: int):
    return ((-width, 0), *NOMINAL[0][1:]) if template == 0 else ((-width, 0),)


def decode_patterns(data: bytes, width: int, height: int, most: int, template: int = 0, mmr: bool = False) -> list[np.ndarray]:
    """Patterns 0..most, which lie side by side in one bitmap."""
    from bitloom.functions import mmr as fax

    whole = (most + 1) * width
    both = fax.decode(data, whole, height)[0] if mmr else decode_generic(mq.Decoder(data), whole, height, template, _pattern_at(template, width))
    return [both[:, k * width : (k + 1) * width].copy() for k in range(most + 1)]


def encode_patterns(patterns: list[np.ndarray], template: int = 0, mmr: bool = False) -> bytes:
    from bitloom.functions import mmr as fax

    both = np.concatenate(patterns, 1)
    if mmr:
        return fax.encode(both)
    enc = mq.Encoder()
    encode_generic(enc, both, template, _pattern_at(template, patterns[0].shape[1]))
    return enc.finish()


def gray_planes(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Gray-coded bit planes, the highest first."""
    g = values ^ values >> 1
    return [(g >> k & 1).astype(np.uint8) for k in reversed(range(bits))]


def from_gray_planes(planes: list[np.ndarray]) -> np.ndarray:
    value = np.zeros(planes[0].shape, np.int64)
    last = np.zeros(planes[0].shape, np.int64)
    for p in planes:
        last = last ^ p
        value = value << 1 | last
    return value


def _halftone_at(template: int):
    return ((3 if template <= 1 else 2, -1), (-3, -1), (2, -2), (-2, -2)) if template == 0 else ((3 if template <= 1 else 2, -1),)


def halftone_skip(shape: tuple[int, int], size: tuple[int, int], grid: tuple[int, int, int, int], pattern: tuple[int, int]) -> np.ndarray:
    """Grid places whose pattern would lie outside of the region."""
    y, x = _grid(size, grid)
    return ((x + pattern[1] <= 0) | (x >= shape[1]) | (y + pattern[0] <= 0) | (y >= shape[0])).astype(np.uint8)


def _grid(size: tuple[int, int], grid: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each grid place: grid is (x, y, step x, step y) in 1/256."""
    gx, gy, rx, ry = grid
    m, n = np.mgrid[: size[0], : size[1]]
    return (gy + m * rx - n * ry) >> 8, (gx + m * ry + n * rx) >> 8


def decode_gray(data: bytes, size: tuple[int, int], bits: int, template: int = 0, mmr: bool = False, skip: np.ndarray | None = None) -> np.ndarray:
    from bitloom.functions import mmr as fax

    planes, at = [], 0
    dec = None if mmr else mq.Decoder(data)
    states = bytearray(contexts_of(template))
    for _ in range(bits):
        if mmr:
            plane, at = fax.decode(data, size[1], size[0], at)
        else:
            plane = decode_generic(dec, size[1], size[0], template, _halftone_at(template), states=states, skip=skip)
        planes.append(plane)
    return from_gray_planes(planes) if planes else np.zeros(size, np.int64)


def encode_gray(values: np.ndarray, bits: int, template: int = 0, mmr: bool = False, skip: np.ndarray | None = None) -> bytes:
    from bitloom.functions import mmr as fax

    planes = gray_planes(values, bits)
    if mmr:
        return b"".join(fax.encode(p) for p in planes)
    enc, states = mq.Encoder(), bytearray(contexts_of(template))
    for p in planes:
        if skip is not None:
            p = np.where(skip, 0, p).astype(np.uint8)
        encode_generic(enc, p, template, _halftone_at(template), states=states, skip=skip)
    return enc.finish()


OPERATORS = {0: np.bitwise_or, 1: np.bitwise_and, 2: np.bitwise_xor, 3: lambda a, b: 1 - (a ^ b), 4: lambda a, b: b}


def composite(page: np.ndarray, bitmap: np.ndarray, x: int, y: int, operator: int = 0) -> None:
    """Draws a bitmap onto a page, clipped."""
    h, w = bitmap.shape
    y0, y1, x0, x1 = max(0, y), min(page.shape[0], y + h), max(0, x), min(page.shape[1], x + w)
    if y1 > y0 and x1 > x0:
        page[y0:y1, x0:x1] = OPERATORS[operator](page[y0:y1, x0:x1], bitmap[y0 - y : y1 - y, x0 - x : x1 - x])


def draw_halftone(shape: tuple[int, int], values: np.ndarray, patterns: list[np.ndarray], grid: tuple[int, int, int, int], operator: int = 0, paper: int = 0, skip: np.ndarray | None = None) -> np.ndarray:
    out = np.full(shape, paper, np.uint8)
    ys, xs = _grid(values.shape, grid)
    for m, n in np.ndindex(values.shape):
        if skip is None or not skip[m, n]:
            composite(out, patterns[min(int(values[m, n]), len(patterns) - 1)], int(xs[m, n]), int(ys[m, n]), operator)
    return out
