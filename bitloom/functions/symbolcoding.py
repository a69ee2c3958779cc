"""Symbol dictionaries and text regions (T.88 6.4, 6.5), arithmetic or Huffman coded,
with refinement and aggregation.

Both codings ask for the same named values in the same order; what differs is held by
a source (``ArithmeticIn``, ``HuffmanIn``) or a sink (``ArithmeticOut``,
``HuffmanOut``). A sink and a source of the same kind walk the same path, so every
procedure below is written once for each direction.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from bitloom.functions import huffman, mmr, mq, regions
from bitloom.functions.mq import code_length

BOTTOM_LEFT, TOP_LEFT, BOTTOM_RIGHT, TOP_RIGHT = range(4)


@dataclass
class TextRules:
    width: int
    height: int
    instances: int
    huffman: bool = False
    refine: bool = False
    log_strips: int = 0
    corner: int = TOP_LEFT
    transposed: bool = False
    operator: int = 0
    paper: int = 0
    offset: int = 0
    template: int = 0
    at: tuple = regions.REFINE_AT
    #: By name: numbers of standard tables, or tables.
    tables: dict = field(default_factory=dict)


@dataclass
class Instance:
    """A symbol at (x, y), its upper left corner; ``bitmap`` differs from the symbol
    where it is refined."""

    symbol: int
    x: int
    y: int
    bitmap: np.ndarray | None = None


#: A symbol of more pixels is taken for damage.
LARGEST = 1 << 24


class ArithmeticIn:
    def __init__(self, data: bytes, length: int, contexts: dict | None = None):
        self.dec, self.length = mq.Decoder(data), length
        self.own: dict[str, bytearray] = {}
        self.pixels = contexts if contexts is not None else {}

    def states(self, name: str, n: int = 512) -> bytearray:
        return self.own.setdefault(name, bytearray(n))

    def get(self, name: str) -> int | None:
        return mq.decode_integer(self.dec, self.states(name))

    def symbol(self) -> int:
        return mq.decode_id(self.dec, self.states("id", 1 << self.length), self.length)

    def within_strip(self, log: int) -> int:
        return self.get("it") if log else 0

    def flag(self) -> int:
        return self.get("ri")

    def generic(self, width: int, height: int, template: int, at) -> np.ndarray:
        return regions.decode_generic(self.dec, width, height, template, at, states=self.pixels.setdefault("generic", bytearray(1 << 16)))

    def refined(self, width: int, height: int, symbol: np.ndarray, dx: int, dy: int, template: int, at, size: str = "") -> np.ndarray:
        return regions.decode_refinement(self.dec, width, height, symbol, dx, dy, template, at, states=self.pixels.setdefault("refinement", bytearray(1 << 13)))


class ArithmeticOut:
    def __init__(self, length: int):
        self.enc, self.length = mq.Encoder(), length
        self.own: dict[str, bytearray] = {}
        self.pixels: dict[str, bytearray] = {}

    states = ArithmeticIn.states

    def put(self, name: str, v: int | None) -> None:
        mq.encode_integer(self.enc, self.states(name), v)

    def symbol(self, v: int) -> None:
        mq.encode_id(self.enc, self.states("id", 1 << self.length), self.length, v)

    def within_strip(self, log: int, v: int) -> None:
        if log:
            self.put("it", v)

    def flag(self, v: int) -> None:
        self.put("ri", v)

    def generic(self, bitmap: np.ndarray, template: int, at) -> None:
        regions.encode_generic(self.enc, bitmap, template, at, states=self.pixels.setdefault("generic", bytearray(1 << 16)))

    def refined(self, bitmap: np.ndarray, symbol: np.ndarray, dx: int, dy: int, template: int, at, size: str = "") -> None:
        regions.encode_refinement(self.enc, bitmap, symbol, dx, dy, template, at, states=self.pixels.setdefault("refinement", bytearray(1 << 13)))

    def finish(self) -> bytes:
        return self.enc.finish()


#: Standard tables by name where a segment chooses no other.
TEXT_TABLES = {"fs": 6, "ds": 8, "dt": 11, "rdw": 14, "rdh": 14, "rdx": 14, "rdy": 14, "rsize": 1}
SYMBOL_TABLES = {"dh": 4, "dw": 2, "bmsize": 1, "ai": 1, "ex": 1}


def _table(tables: dict, name: str) -> huffman.Table:
    t = tables.get(name, TEXT_TABLES.get(name) or SYMBOL_TABLES.get(name))
    return huffman.standard(t) if isinstance(t, int) else t


class HuffmanIn:
    def __init__(self, reader: huffman.Reader, tables: dict, symbols: huffman.Table | int, contexts: dict | None = None):
        self.r, self.tables, self.symbols = reader, tables, symbols
        self.pixels = contexts if contexts is not None else {}

    def get(self, name: str) -> int | None:
        return _table(self.tables, name).decode(self.r)

    def symbol(self) -> int:
        return self.r.bits(self.symbols) if isinstance(self.symbols, int) else self.symbols.decode(self.r)

    def within_strip(self, log: int) -> int:
        return self.r.bits(log)

    def flag(self) -> int:
        return self.r.bits(1)

    def refined(self, width: int, height: int, symbol: np.ndarray, dx: int, dy: int, template: int, at, size: str = "rsize") -> np.ndarray:
        n = self.get(size)
        data = self.r.take(n)
        return regions.decode_refinement(mq.Decoder(data), width, height, symbol, dx, dy, template, at, states=self.pixels.setdefault("refinement", bytearray(1 << 13)))


class HuffmanOut:
    def __init__(self, tables: dict, symbols: huffman.Table | int, writer: huffman.Writer | None = None):
        self.w, self.tables, self.symbols = writer or huffman.Writer(), tables, symbols
        self.pixels: dict[str, bytearray] = {}

    def put(self, name: str, v: int | None) -> None:
        _table(self.tables, name).encode(self.w, v)

    def symbol(self, v: int) -> None:
        if isinstance(self.symbols, int):
            self.w.bits(v, self.symbols)
        else:
            self.symbols.encode(self.w, v)

    def within_strip(self, log: int, v: int) -> None:
        self.w.bits(v, log)

    def flag(self, v: int) -> None:
        self.w.bits(v, 1)

    def refined(self, bitmap: np.ndarray, symbol: np.ndarray, dx: int, dy: int, template: int, at, size: str = "rsize") -> None:
        enc = mq.Encoder()
        regions.encode_refinement(enc, bitmap, symbol, dx, dy, template, at, states=self.pixels.setdefault("refinement", bytearray(1 << 13)))
        data = enc.finish()
        self.put(size, len(data))
        self.w.add(data)

    def finish(self) -> bytes:
        return self.w.finish()


# ---- text regions --------------------------------------------------------------------


def _moves(rules: TextRules, w: int, h: int) -> tuple[int, int]:
    """What a symbol of this size adds to the running coordinate, before and after."""
    if rules.transposed:
        return (h - 1, 0) if rules.corner in (BOTTOM_LEFT, BOTTOM_RIGHT) else (0, h - 1)
    return (w - 1, 0) if rules.corner in (TOP_RIGHT, BOTTOM_RIGHT) else (0, w - 1)


def origin(rules: TextRules, s: int, t: int, w: int, h: int) -> tuple[int, int]:
    """Upper left corner of a symbol whose reference corner is at (s, t)."""
    x, y = (t, s) if rules.transposed else (s, t)
    return x - (w - 1 if rules.corner in (TOP_RIGHT, BOTTOM_RIGHT) else 0), y - (h - 1 if rules.corner in (BOTTOM_LEFT, BOTTOM_RIGHT) else 0)


def _corner(rules: TextRules, x: int, y: int, w: int, h: int) -> tuple[int, int]:
    """(s, t) of a symbol's reference corner: the way back of ``origin``."""
    x += w - 1 if rules.corner in (TOP_RIGHT, BOTTOM_RIGHT) else 0
    y += h - 1 if rules.corner in (BOTTOM_LEFT, BOTTOM_RIGHT) else 0
    return (y, x) if rules.transposed else (x, y)


def decode_instances(src, rules: TextRules, symbols: list[np.ndarray]) -> list[Instance]:
    strips = 1 << rules.log_strips
    out: list[Instance] = []
    strip = -src.get("dt") * strips
    first = 0
    while len(out) < rules.instances:
        strip += src.get("dt") * strips
        begun = False
        while True:
            if not begun:
                first += src.get("fs")
                s, begun = first, True
            else:
                step = src.get("ds")
                if step is None:
                    break
                s += step + rules.offset
            if len(out) >= rules.instances:
                raise ValueError("more symbol instances than declared")
            t = strip + src.within_strip(rules.log_strips)
            k = src.symbol()
            if not 0 <= k < len(symbols):
                raise ValueError("no such symbol")
            bitmap, own = symbols[k], None
            if rules.refine and src.flag():
                dw, dh, dx, dy = (src.get(n) for n in ("rdw", "rdh", "rdx", "rdy"))
                h, w = bitmap.shape
                if w + dw < 0 or h + dh < 0 or (w + dw) * (h + dh) > LARGEST:
                    raise ValueError("a refined symbol of impossible size")
                bitmap = own = src.refined(w + dw, h + dh, bitmap, (dw >> 1) + dx, (dh >> 1) + dy, rules.template, rules.at)
            h, w = bitmap.shape
            before, after = _moves(rules, w, h)
            s += before
            out.append(Instance(k, *origin(rules, s, t, w, h), own))
            s += after
    return out


def encode_instances(sink, rules: TextRules, symbols: list[np.ndarray], instances: list[Instance]) -> None:
    strips = 1 << rules.log_strips
    placed = []
    for i in instances:
        bitmap = i.bitmap if i.bitmap is not None else symbols[i.symbol]
        s, t = _corner(rules, i.x, i.y, bitmap.shape[1], bitmap.shape[0])
        placed.append((t // strips, s, t, i, bitmap))
    placed.sort(key=lambda p: (p[0], p[1], p[2], p[3].symbol))
    # steps between strips are at least 1, the first one included
    lead = max(1, 1 - placed[0][0]) if placed else 1
    sink.put("dt", lead)
    strip, first = -lead, 0
    at = None
    for k, (row, s, t, i, bitmap) in enumerate(placed):
        h, w = bitmap.shape
        before, after = _moves(rules, w, h)
        start = s - before
        if at is None or row != strip:
            if at is not None:
                sink.put("ds", None)
            sink.put("dt", row - strip)
            strip = row
            sink.put("fs", start - first)
            first = start
        else:
            sink.put("ds", start - at - rules.offset)
        sink.within_strip(rules.log_strips, t - row * strips)
        sink.symbol(i.symbol)
        if rules.refine:
            sink.flag(int(i.bitmap is not None))
            if i.bitmap is not None:
                old = symbols[i.symbol]
                dw, dh = w - old.shape[1], h - old.shape[0]
                for n, v in (("rdw", dw), ("rdh", dh), ("rdx", -(dw >> 1)), ("rdy", -(dh >> 1))):
                    sink.put(n, v)
                sink.refined(bitmap, old, 0, 0, rules.template, rules.at)
        at = s + after
    if at is not None:
        sink.put("ds", None)


def draw_text(rules: TextRules, symbols: list[np.ndarray], instances: list[Instance]) -> np.ndarray:
    out = np.full((rules.height, rules.width), rules.paper, np.uint8)
    for i in instances:
        regions.composite(out, i.bitmap if i.bitmap is not None else symbols[i.symbol], i.x, i.y, rules.operator)
    return out


def decode_text(data: bytes, rules: TextRules, symbols: list[np.ndarray]) -> np.ndarray:
    if rules.huffman:
        r = huffman.Reader(data)
        src = HuffmanIn(r, rules.tables, huffman.read_id_codes(r, len(symbols)))
    else:
        src = ArithmeticIn(data, code_length(len(symbols)))
    return draw_text(rules, symbols, decode_instances(src, rules, symbols))


def encode_text(rules: TextRules, symbols: list[np.ndarray], instances: list[Instance]) -> bytes:
    if rules.huffman:
        w = huffman.Writer()
        sink = HuffmanOut(rules.tables, huffman.write_id_codes(w, len(symbols)), w)
    else:
        sink = ArithmeticOut(code_length(len(symbols)))
    encode_instances(sink, rules, symbols, instances)
    return sink.finish()


# ---- symbol dictionaries -------------------------------------------------------------


@dataclass
class SymbolRules:
    new: int
    exported: int
    huffman: bool = False
    aggregate: bool = False
    template: int = 0
    at: tuple | None = None
    refine_template: int = 0
    refine_at: tuple = regions.REFINE_AT
    tables: dict = field(default_factory=dict)


def _aggregate_rules(rules: SymbolRules, w: int, h: int, n: int) -> TextRules:
    tables = {"fs": 6, "ds": 8, "dt": 11, "rdw": 15, "rdh": 15, "rdx": 15, "rdy": 15, "rsize": 1}
    return TextRules(w, h, n, rules.huffman, True, template=rules.refine_template, at=rules.refine_at, tables=tables)


_AGGREGATE_TABLES = {"rdx": 15, "rdy": 15, "rdw": 15, "rdh": 15, "rsize": 1, "fs": 6, "ds": 8, "dt": 11}


def decode_symbols(data: bytes, rules: SymbolRules, imported: list[np.ndarray], contexts: dict | None = None) -> list[np.ndarray]:
    """The exported symbols. ``contexts`` holds the pixel contexts that dictionaries may
    hand on to each other."""
    symbols = list(imported)
    length = code_length(len(imported) + rules.new)
    if rules.huffman:
        src = HuffmanIn(huffman.Reader(data), _AGGREGATE_TABLES | rules.tables, max(1, length), contexts)
    else:
        src = ArithmeticIn(data, length, contexts)
    height = 0
    made: list[np.ndarray] = []
    while len(made) < rules.new:
        height += src.get("dh")
        width, widths = 0, []
        while True:
            step = src.get("dw")
            if step is None:
                break
            width += step
            if len(made) + len(widths) >= rules.new or width < 0 or height < 0 or width * height > LARGEST:
                raise ValueError("more symbols than declared, or of negative size")
            if rules.huffman and not rules.aggregate:
                widths.append(width)
                continue
            if not rules.aggregate:
                bitmap = src.generic(width, height, rules.template, rules.at)
            else:
                n = src.get("ai")
                if n == 1:
                    k, dx, dy = src.symbol(), src.get("rdx"), src.get("rdy")
                    if k >= len(symbols):
                        raise ValueError("a refinement of a symbol that isn't there yet")
                    bitmap = src.refined(width, height, symbols[k], dx, dy, rules.refine_template, rules.refine_at)
                else:
                    text = _aggregate_rules(rules, width, height, n)
                    bitmap = draw_text(text, symbols, decode_instances(src, text, symbols))
            made.append(bitmap)
            symbols.append(bitmap)
        if widths:
            size, total = src.get("bmsize"), sum(widths)
            if size:
                both = mmr.decode(src.r.take(size), total, height)[0]
            else:
                raw = np.frombuffer(src.r.take(height * (total + 7 >> 3)), np.uint8).reshape(height, -1)
                both = np.unpackbits(raw, axis=1)[:, :total]
            made += [x.copy() for x in np.split(both, np.cumsum(widths)[:-1], 1)]
            symbols = [*imported, *made]
        if not widths and rules.huffman and not rules.aggregate:
            src.get("bmsize")
    flags: list[int] = []
    on = 0
    while len(flags) < len(symbols):
        n = src.get("ex")
        if n is None or n < 0 or len(flags) + n > len(symbols):
            raise ValueError("export runs don't fit")
        flags += [on] * n
        on ^= 1
    out = [s for s, f in zip(symbols, flags) if f]
    if len(out) != rules.exported:
        raise ValueError("another number of exported symbols than declared")
    return out


def encode_symbols(rules: SymbolRules, symbols: list[np.ndarray], imported: list[np.ndarray] = (), refined: dict[int, tuple[int, int, int]] | None = None, aggregates: dict[int, list[Instance]] | None = None) -> bytes:
    """``symbols`` in order of height. With ``aggregate``: ``refined`` gives (symbol, dx,
    dy) and ``aggregates`` the instances that make a symbol, by its place; numbers count
    from the imported ones."""
    length = code_length(len(imported) + rules.new)
    sink = HuffmanOut(_AGGREGATE_TABLES | rules.tables, max(1, length)) if rules.huffman else ArithmeticOut(length)
    known = list(imported)
    height = k = 0
    while k < len(symbols):
        here = [s for s in symbols[k:] if s.shape[0] == symbols[k].shape[0]]
        here = symbols[k : k + len(here)]
        sink.put("dh", here[0].shape[0] - height)
        height, width = here[0].shape[0], 0
        for j, s in enumerate(here, k):
            sink.put("dw", s.shape[1] - width)
            width = s.shape[1]
            if rules.aggregate:
                if refined and j in refined:
                    base, dx, dy = refined[j]
                    sink.put("ai", 1)
                    sink.symbol(base)
                    sink.put("rdx", dx)
                    sink.put("rdy", dy)
                    sink.refined(s, known[base], dx, dy, rules.refine_template, rules.refine_at)
                else:
                    parts = aggregates[j]
                    sink.put("ai", len(parts))
                    encode_instances(sink, _aggregate_rules(rules, s.shape[1], s.shape[0], len(parts)), known, parts)
            elif not rules.huffman:
                sink.generic(s, rules.template, rules.at)
            known.append(s)
        sink.put("dw", None)
        if rules.huffman and not rules.aggregate:
            data = mmr.encode(np.concatenate(here, 1), end=False)
            raw = np.packbits(np.concatenate(here, 1), axis=1).tobytes()
            sink.put("bmsize", 0 if len(raw) <= len(data) else len(data))
            sink.w.add(raw if len(raw) <= len(data) else data)
        k += len(here)
    sink.put("ex", len(imported))
    sink.put("ex", len(symbols))
    return sink.finish()
