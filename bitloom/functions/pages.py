"""Whole pages: decoding a stream's segments and encoding bitmaps as streams.

A stream is decoded front to back; what segments leave for later ones (symbols,
patterns, tables, bitmaps) is kept by segment number. A bitmap is encoded as one
generic region, as a symbol dictionary with a text region, or as whichever is smaller.
"""

from __future__ import annotations

import struct
from collections import Counter
from dataclasses import dataclass

import numpy as np

from bitloom.functions import huffman, mmr, mq, regions
from bitloom.functions import symbolcoding as sc
from bitloom.sources import streams as st

#: Pixels of a page or region, and symbols or instances of a segment, beyond which a
#: stream is taken for damaged.
LIMIT, COUNT = 1 << 28, 10_000_000


class _Segments(st.Parser):
    """Finds the end of a generic region of unknown length (7.2.7)."""

    def segment(self, start: int) -> int | None:
        end = super().segment(start)
        if end is None:
            return None
        s = self.segments[-1]
        if s["data_length"] is None and s["stype"] in st.GENERIC and len(s["body"]) > 18:
            mark = b"\0\0" if s["body"][17] & 1 else b"\xff\xac"
            at = s["body"].find(mark, 18)
            if at >= 0:
                body = s["body"][: at + 2]
                rows = s["body"][at + 2 : at + 6]
                s["body"] = body[:4] + rows + body[8:] if len(rows) == 4 else body
                end = start + s["hl"] + at + 6
        return min(end, len(self.data))


@dataclass
class Page:
    number: int
    bitmap: np.ndarray
    error: str | None = None


def _signed(body: bytes, at: int, n: int) -> list[tuple[int, int]]:
    v = struct.unpack_from(f">{2 * n}b", body, at)
    return list(zip(v[::2], v[1::2]))


class Document:
    def __init__(self, data: bytes):
        self.parsed = _Segments(data)
        self.by_number = {s["number"]: s for s in self.parsed.segments}
        self.symbols: dict[int, list[np.ndarray]] = {}
        self.patterns: dict[int, list[np.ndarray]] = {}
        self.tables: dict[int, huffman.Table] = {}
        self.bitmaps: dict[int, np.ndarray] = {}
        self.contexts: dict[int, dict] = {}
        self.pages: dict[int, Page] = {}
        self.flags: dict[int, int] = {}

    def decode(self) -> list[Page]:
        """All pages; one that fails has what was drawn before and the error."""
        for k, s in enumerate(self.parsed.segments):
            page = self.pages.get(s["page"])
            if page is not None and page.error:
                continue
            try:
                self.step(k, s)
            except (ValueError, IndexError, KeyError, TypeError, struct.error, OverflowError, MemoryError) as e:
                if s["page"] in self.pages:
                    self.pages[s["page"]].error = f"segment {s['number']}: {e}"
        if self.parsed.said:
            for p in self.pages.values():
                p.error = p.error or self.parsed.said[0]["message"]
        return [self.pages[k] for k in sorted(self.pages)]

    def step(self, k: int, s: dict) -> None:
        kind, body, n = s["stype"], s["body"], s["number"]
        if kind == 48:
            height = 0 if s["page_height"] == 0xFFFFFFFF else s["page_height"]
            if s["page_width"] * max(height, 1) > LIMIT:
                raise ValueError("the page is too large")
            self.flags[s["page"]] = s["flags8"] or 0
            self.pages[s["page"]] = Page(s["page"], np.full((height, s["page_width"]), (s["flags8"] or 0) >> 2 & 1, np.uint8))
        elif kind == 50:
            self.grow(s["page"], int.from_bytes(body[:4], "big") + 1)
        elif kind == 0:
            self.symbols[n] = self.dictionary(k, s)
        elif kind == 16:
            flags, w, h, most = struct.unpack_from(">BBBI", body)
            if (most + 1) * w * h > LIMIT:
                raise ValueError("too many patterns")
            self.patterns[n] = regions.decode_patterns(body[7:], w, h, most, flags >> 1 & 3, bool(flags & 1))
        elif kind == 53:
            self.tables[n] = huffman.sent(body)
        elif kind in st.REGIONS:
            if s["rw"] is None or s["rw"] * s["rh"] > LIMIT:
                raise ValueError("a region without size, or too large")
            make = self.text if kind in st.TEXT else self.halftone if kind in st.HALFTONE else self.generic if kind in st.GENERIC else self.refinement
            bitmap = make(k, s)
            if kind in (4, 20, 36, 40):
                self.bitmaps[n] = bitmap
            else:
                self.grow(s["page"], s["ry"] + s["rh"])
                regions.composite(self.pages[s["page"]].bitmap, bitmap, s["rx"], s["ry"], s["rflags"] & 7)

    def grow(self, number: int, height: int) -> None:
        """A page of unknown height is as high as what comes."""
        page = self.pages[number]
        info = next(s for s in self.parsed.segments if s["stype"] == 48 and s["page"] == number)
        if info["page_height"] == 0xFFFFFFFF and height > page.bitmap.shape[0]:
            more = np.full((height - page.bitmap.shape[0], page.bitmap.shape[1]), self.flags[number] >> 2 & 1, np.uint8)
            page.bitmap = np.concatenate([page.bitmap, more])

    def referred(self, k: int, s: dict, what: dict, policy: str = "") -> list:
        """What the referred-to segments offer, in their order; where that is nothing, the
        segments before, of this page or of none: all of them or the latest."""
        got = [what[r] for r in s["referred"] if r in what]
        if not got and policy:
            got = [what[p["number"]] for p in self.parsed.segments[:k] if p["number"] in what and p["page"] in (0, s["page"])]
            got = got[-1:] if policy == "latest" else got
        return got

    def chosen(self, k: int, s: dict, picks: list[tuple[str, int, dict[int, int]]]) -> dict:
        """Huffman tables by name: a choice is a standard table or the next one sent."""
        sent = self.referred(k, s, self.tables)
        out = {}
        for name, choice, standard in picks:
            if choice in standard:
                out[name] = standard[choice]
            elif sent:
                out[name] = sent.pop(0)
            else:
                raise ValueError("a Huffman table is missing")
        return out

    def dictionary(self, k: int, s: dict) -> list[np.ndarray]:
        body, f = s["body"], s["flags16"]
        at = 2
        rules = sc.SymbolRules(s["n_new"], s["n_exp"], bool(f & 1), bool(f & 2), f >> 10 & 3, None, f >> 12 & 1)
        if not rules.huffman:
            n = 4 if rules.template == 0 else 1
            rules.at = _signed(body, at, n)
            at += 2 * n
        if rules.aggregate and not rules.refine_template:
            rules.refine_at = _signed(body, at, 2)
            at += 4
        if rules.huffman:
            rules.tables = self.chosen(k, s, [("dh", f >> 2 & 3, {0: 4, 1: 5}), ("dw", f >> 4 & 3, {0: 2, 1: 3}), ("bmsize", f >> 6 & 1, {0: 1}), ("ai", f >> 7 & 1, {0: 1})])
        if max(rules.new, rules.exported) > COUNT:
            raise ValueError("an implausible number of symbols")
        imported = [x for d in self.referred(k, s, self.symbols, "all") for x in d]
        contexts: dict = {}
        if f & 0x100:
            earlier = self.referred(k, s, self.contexts)
            contexts = {name: bytearray(v) for name, v in earlier[-1].items()} if earlier else {}
        out = sc.decode_symbols(body[at + 8 :], rules, imported, contexts)
        if f & 0x200:
            self.contexts[s["number"]] = contexts
        return out

    def text(self, k: int, s: dict) -> np.ndarray:
        body, f = s["body"], s["flags16"]
        offset = f >> 10 & 31
        rules = sc.TextRules(s["rw"], s["rh"], s["n_inst"], bool(f & 1), bool(f & 2), f >> 2 & 3, f >> 4 & 3, bool(f & 64), f >> 7 & 3, f >> 9 & 1, offset - 32 if offset > 15 else offset, f >> 15)
        at = 19
        if rules.huffman:
            h = s["huff_flags"]
            at += 2
            refine = {0: 14, 1: 15}
            rules.tables = self.chosen(k, s, [("fs", h & 3, {0: 6, 1: 7}), ("ds", h >> 2 & 3, {0: 8, 1: 9, 2: 10}), ("dt", h >> 4 & 3, {0: 11, 1: 12, 2: 13}), *[(n, h >> b & 3, refine) for n, b in (("rdw", 6), ("rdh", 8), ("rdx", 10), ("rdy", 12))], ("rsize", h >> 14 & 1, {0: 1})])
        if rules.refine and not rules.template:
            rules.at = _signed(body, at, 2)
            at += 4
        symbols = [x for d in self.referred(k, s, self.symbols, "latest") for x in d]
        if not symbols or s["n_inst"] > COUNT:
            raise ValueError("a text region without symbols, or with implausibly many")
        return sc.decode_text(body[at + 4 :], rules, symbols)

    def generic(self, k: int, s: dict) -> np.ndarray:
        body, f = s["body"], s["flags8"]
        if f & 1:
            return mmr.decode(body, s["rw"], s["rh"], 18)[0]
        template, extended = f >> 1 & 3, bool(f & 16)
        n = 12 if extended and not template else 4 if template == 0 else 1
        at = _signed(body, 18, n)
        return regions.decode_generic(mq.Decoder(body, 18 + 2 * n), s["rw"], s["rh"], template, at, bool(f & 8), extended=extended and not template)

    def refinement(self, k: int, s: dict) -> np.ndarray:
        body, f = s["body"], s["flags8"]
        at = _signed(body, 18, 2) if not f & 1 else None
        old = self.referred(k, s, self.bitmaps)
        if old:
            reference = old[0]
        else:  # the page itself, where the region lies
            page = self.pages[s["page"]].bitmap
            reference = page[s["ry"] : s["ry"] + s["rh"], s["rx"] : s["rx"] + s["rw"]]
        return regions.decode_refinement(mq.Decoder(body, 18 + (4 if at else 0)), s["rw"], s["rh"], reference, 0, 0, f & 1, at, bool(f & 2))

    def halftone(self, k: int, s: dict) -> np.ndarray:
        f, gw, gh, gx, gy, rx, ry = struct.unpack_from(">BIIiiHH", s["body"], 17)
        patterns = [x for d in self.referred(k, s, self.patterns) for x in d]
        if not patterns or gw * gh > LIMIT:
            raise ValueError("a halftone region without patterns, or with too large a grid")
        shape, grid = (s["rh"], s["rw"]), (gx, gy, rx, ry)
        skip = regions.halftone_skip(shape, (gh, gw), grid, patterns[0].shape) if f & 8 else None
        gray = regions.decode_gray(s["body"][38:], (gh, gw), mq.code_length(len(patterns)), f >> 1 & 3, bool(f & 1), skip)
        return regions.draw_halftone(shape, gray, patterns, grid, f >> 4 & 7, f >> 7, skip)


def decode_document(data: bytes) -> list[Page]:
    return Document(data).decode()


# ---- encoding ------------------------------------------------------------------------


@dataclass(frozen=True)
class EncodeRules:
    """``mode``: generic, mmr, symbol, symbol_huffman, or smallest of generic and symbol."""

    mode: str = "smallest"
    template: int = 0
    typical: bool = True
    #: Two symbols are one where their differing pixels are at most this share of the
    #: lesser one's ink; 0 keeps the page as it is.
    disagreement: float = 0.0
    #: Merged symbols are sent as refinements, so nothing is lost after all.
    refine: bool = False


PRESETS = {"fast": EncodeRules("generic", 3, False), "balanced": EncodeRules(), "smallest": EncodeRules("symbol", 0, True, 0.15, True)}


def generic_body(bitmap: np.ndarray, rules: EncodeRules) -> bytes:
    h, w = bitmap.shape
    if rules.mode == "mmr":
        return st.region_bytes(w, h) + b"\x01" + mmr.encode(bitmap)
    enc = mq.Encoder()
    regions.encode_generic(enc, bitmap, rules.template, None, rules.typical)
    at = b"".join(struct.pack(">bb", *p) for p in regions.NOMINAL[rules.template])
    return st.region_bytes(w, h) + bytes([rules.template << 1 | (8 if rules.typical else 0)]) + at + enc.finish()


def components(bitmap: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(x, y, bitmap) of the 8-connected parts, by their first pixel in row order."""
    from bitloom.operators.components import labels

    ys, xs = np.nonzero(bitmap)
    if not len(ys):
        return []
    width = bitmap.shape[1]
    label = np.asarray(labels(ys, xs, width))
    _, which = np.unique(label, return_inverse=True)
    order = np.argsort(which, kind="stable")
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
        y, x = ys[part], xs[part]
        b = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), np.uint8)
        b[y - y.min(), x - x.min()] = 1
        out.append((int(x.min()), int(y.min()), b))
    return out


def xor_distance(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """Differing pixels of two bitmaps laid centre on centre, and their share of the
    lesser one's ink."""
    h, w = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])

    def centred(x: np.ndarray) -> np.ndarray:
        out = np.zeros((h, w), np.uint8)
        dy, dx = (h - x.shape[0]) // 2, (w - x.shape[1]) // 2
        out[dy : dy + x.shape[0], dx : dx + x.shape[1]] = x
        return out

    n = int((centred(a) ^ centred(b)).sum())
    return n, n / max(1, min(int(a.sum()), int(b.sum())))


def leaders(bitmaps: list[np.ndarray], counts: list[int], disagreement: float) -> list[int]:
    """For each bitmap the one that stands for it: the most frequent ones first take
    those of nearly their size and within the distance."""
    to = list(range(len(bitmaps)))
    by_size: dict[tuple[int, int], list[int]] = {}
    for k, b in enumerate(bitmaps):
        by_size.setdefault(b.shape, []).append(k)
    taken = [False] * len(bitmaps)
    for lead in sorted(to, key=lambda k: -counts[k]):
        if taken[lead]:
            continue
        h, w = bitmaps[lead].shape
        for dw in (0, -1, 1):
            for dh in (0, -1, 1):
                for k in by_size.get((h + dh, w + dw), ()):
                    if k != lead and not taken[k] and xor_distance(bitmaps[lead], bitmaps[k])[1] <= disagreement:
                        to[k], taken[k] = lead, True
    return to


def symbol_bodies(bitmap: np.ndarray, rules: EncodeRules) -> tuple[bytes, bytes] | None:
    """Bodies of a symbol dictionary and of a text region; None for an empty page."""
    parts = components(bitmap)
    if not parts:
        return None
    index: dict[tuple, int] = {}
    bitmaps: list[np.ndarray] = []
    which = []
    for _, _, b in parts:
        key = (b.shape, b.tobytes())
        if key not in index:
            index[key] = len(bitmaps)
            bitmaps.append(b)
        which.append(index[key])
    counts = Counter(which)
    to = leaders(bitmaps, [counts[k] for k in range(len(bitmaps))], rules.disagreement) if rules.disagreement else list(range(len(bitmaps)))
    kept = sorted({*to}, key=lambda k: (bitmaps[k].shape, k))
    place = {k: j for j, k in enumerate(kept)}
    symbols = [bitmaps[k] for k in kept]
    instances = []
    for (x, y, b), k in zip(parts, which):
        lead = to[k]
        if lead == k:
            instances.append(sc.Instance(place[k], x, y))
        elif rules.refine:
            instances.append(sc.Instance(place[lead], x, y, b))
        else:  # the leader, centre on centre
            a = bitmaps[lead]
            instances.append(sc.Instance(place[lead], x + (b.shape[1] - a.shape[1]) // 2, y + (b.shape[0] - a.shape[0]) // 2))
    huff = rules.mode == "symbol_huffman"
    refined = any(i.bitmap is not None for i in instances)
    sd = sc.SymbolRules(len(symbols), len(symbols), huff, template=0 if huff else rules.template)
    # dh and dw beyond one table's reach need the other one
    sd.tables = {"dh": 5, "dw": 3} if huff else {}
    text = sc.TextRules(bitmap.shape[1], bitmap.shape[0], len(instances), huff, refined)
    text.tables = {"fs": 7, "ds": 10, "dt": 13, "rdw": 15, "rdh": 15, "rdx": 15, "rdy": 15} if huff else {}
    flags = (1 | 1 << 2 | 1 << 4) if huff else rules.template << 10
    at = b"" if huff else b"".join(struct.pack(">bb", *p) for p in regions.NOMINAL[rules.template])
    dictionary = struct.pack(">H", flags) + at + struct.pack(">II", len(symbols), len(symbols)) + sc.encode_symbols(sd, symbols)
    tflags = int(huff) | (2 if refined else 0) | text.corner << 4
    hflags = struct.pack(">H", 1 | 2 << 2 | 2 << 4 | 1 << 6 | 1 << 8 | 1 << 10 | 1 << 12) if huff else b""
    rat = b"".join(struct.pack(">bb", *p) for p in regions.REFINE_AT) if refined else b""
    region = st.region_bytes(bitmap.shape[1], bitmap.shape[0]) + struct.pack(">H", tflags) + hflags + rat + struct.pack(">I", len(instances)) + sc.encode_text(text, symbols, instances)
    return dictionary, region


def encode_document(pages: list[np.ndarray], rules: EncodeRules = EncodeRules()) -> tuple[bytes, list[str]]:
    """(stream, the mode that each page got)."""
    out, modes, n = [st.file_header(len(pages))], [], 0

    def add(stype: int, body: bytes, page: int, referred: list[int] = ()) -> int:
        nonlocal n
        out.append(st.segment_bytes(n, stype, body, page, referred))
        n += 1
        return n - 1

    for number, bitmap in enumerate(pages, 1):
        add(48, st.page_bytes(bitmap.shape[1], bitmap.shape[0]), number)
        symbol = symbol_bodies(bitmap, rules) if rules.mode in ("smallest", "symbol", "symbol_huffman") else None
        generic = None if symbol and rules.mode != "smallest" else generic_body(bitmap, rules)
        if symbol and (generic is None or sum(map(len, symbol)) < len(generic)):
            modes.append("symbol")
            add(7 if not rules.disagreement or rules.refine else 6, symbol[1], number, [add(0, symbol[0], number)])
        else:
            modes.append("generic")
            add(39, generic, number)
        add(49, b"", number)
    add(51, b"", 0)
    return b"".join(out), modes


def encode_halftone(values: np.ndarray, patterns: list[np.ndarray], template: int = 0, use_mmr: bool = False, skip: bool = False) -> bytes:
    """A one-page stream of a grid of pattern numbers, side by side."""
    h, w = patterns[0].shape
    shape = (values.shape[0] * h, values.shape[1] * w)
    grid = (0, 0, h << 8, 0)
    if h != w:
        raise ValueError("patterns on an upright grid are square")
    out = [st.file_header(1), st.segment_bytes(0, 48, st.page_bytes(shape[1], shape[0]), 1)]
    out.append(st.segment_bytes(1, 16, struct.pack(">BBBI", int(use_mmr) | template << 1, w, h, len(patterns) - 1) + regions.encode_patterns(patterns, template, use_mmr), 1))
    hidden = regions.halftone_skip(shape, values.shape, grid, (h, w)) if skip else None
    data = regions.encode_gray(values, mq.code_length(len(patterns)), template, use_mmr, hidden)
    head = struct.pack(">BIIiiHH", int(use_mmr) | template << 1 | (8 if skip else 0), values.shape[1], values.shape[0], *grid)
    out.append(st.segment_bytes(2, 23, st.region_bytes(shape[1], shape[0]) + head + data, 1, [1]))
    return b"".join([*out, st.segment_bytes(3, 49, b"", 1), st.segment_bytes(4, 51, b"", 0)])
