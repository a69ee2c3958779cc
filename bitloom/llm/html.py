r"""HTML extraction by union-free regular-expression inference over a host's pages.

A page is a stream of tags and texts. Its *shape* is that stream as an
expression: a letter for each tag, ``#`` for a text, and ``(unit)+`` where a unit
follows itself (lists, tables, paragraphs), found inside out: units of up to 40 tokens
by regular expressions, short ones first, then longer ones of any length by their
period. Tags are told apart by name, not by attributes; names beyond the table of
common ones share 851,968 letters by hash. The wrapper of a
host is the expression that all its pages' shapes match: shapes are aligned one
after another along a longest common subsequence of their items; an item that
one side lacks becomes optional, ``( )?``; a single unit facing its repetition
becomes repeated; two repetitions facing each other at the same place are aligned
inside. There is no disjunction. A text that is the same on all pages of the
host that have it, at least two pages of different texts, is part of the
template; all others are slots of the data.
A page's result is the texts of its slots.

Alignment works on distinct shapes, not on pages: tasks reduce their pages to
(host, shape, count, the ranges of the hashes of each text and of the pages), salted parts of a host are
aligned in parallel and their wrappers aligned once more, so a hot host is no
task of its own, and no page text is shuffled for the inference. Extraction reads
the pages again and looks each one's texts up in its host's wrapper: the wrappers are
broadcast while they are smaller than ``broadcast_bytes`` (checked), else each is
copied to ``salts`` places that share its host's pages.

Defined results: null HTML has null ``text`` and no slots; HTML without texts has
an empty text; comments, scripts, styles, declarations are no tokens; an unclosed
one of them ends the page; pages without a host (null or blank URL) form one
group; on a host of which no text varies (one page, or copies of one page), every
text counts as data; pages of any length are parsed whole; repeated rows are extracted
once each; ``page_id`` may be of any type; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.session import materialize, table

_TAGS = (
    "html head title meta link base body header footer main nav section article aside div span p a b i u s em strong small big sub sup br hr img"
    " h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr th td col colgroup form input button select option optgroup label"
    " textarea fieldset legend iframe embed object param video audio source track canvas svg path g picture figure figcaption blockquote q cite"
    " code pre kbd samp var abbr address time mark ins del details summary dialog template noscript center font tt wbr ruby rt rp"
).split()
_LETTER = {name: chr(0x100 + 2 * k) for k, name in enumerate(_TAGS)} | {f"/{name}": chr(0x101 + 2 * k) for k, name in enumerate(_TAGS)}
#: Tags, with their name; what is no token has none.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?[a-z][^\s/<>]*)(?:(?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*+>|[^<>]*>)",
    re.I | re.S,
)
#: A unit that follows itself at once; short ones first, so inner ones first.
_REPEATS = [re.compile(rf"(.{{1,{n}}}?)\1+", re.S) for n in (5, 10, 20, 40)]
#: Characters from here on stand for units within a page.
_PLACE, _PLACES = 0xF0000, 0xFFFE
_SHORT = 40


def letter(tag: str) -> str:
    """One character per tag name; names beyond the table share 851,968."""
    tag = tag.lower()
    got = _LETTER.get(tag)
    if got is None:
        got = chr(0x20000 + xxhash.xxh64_intdigest(tag.encode("utf-8", "surrogatepass")) % 0xD0000)
        if len(_LETTER) < 100_000:
            _LETTER[tag] = got
    return got


def tokens(html: str) -> tuple[str, list[str]]:
    """(a letter per tag and '#' per text, the texts)."""
    parts = _TOKEN.split(html)
    out: list[str] = []
    texts: list[str] = []
    glue = False
    for k in range(0, len(parts), 2):
        t = parts[k]
        if t and not t.isspace():
            t = " ".join((unescape(t) if "&" in t else t).split())
            if t:
                if glue:  # only a comment or the like between two texts
                    texts[-1] += " " + t
                else:
                    out.append("#")
                    texts.append(t)
                    glue = True
        if k + 1 < len(parts) and parts[k + 1]:
            out.append(_LETTER.get(parts[k + 1]) or letter(parts[k + 1]))
            glue = False
    return "".join(out), texts


def long_repeats(s: str) -> list[tuple[int, int, int]]:
    """(start, end, length of the unit) of the places at which a unit of more than
    ``_SHORT`` items follows itself, for the shortest such unit."""
    v = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    n, g = len(v), 8
    if n < 2 * (_SHORT + 1):
        return []
    h = np.zeros(n - g + 1, np.uint64)
    for k in range(g):
        h = h * np.uint64(0x100000001B3) + v[k : n - g + 1 + k]
    for p in range(_SHORT + 1, n // 2 + 1):
        # n / p places are enough: a run of p equal items covers one of them, and eight items before or after it
        j = np.arange(0, n - p, p)
        after = j[j + p < len(h)]
        before = j[j >= g] - g
        if not (h[after] == h[after + p]).any() and not (h[before] == h[before + p]).any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (v[:-p] == v[p:]).astype(np.int8), [0]))))
        out, last = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            a = max(a, last)
            if b - a >= p:
                last = a + p * ((b - a) // p + 1)
                out.append((a, last, p))
        if out:
            return out
    return []


def shape(stream: str) -> tuple[list[str], list[int]]:
    """Top-level items of a stream ('#', a letter or '(unit)+'), and the number
    of texts in each."""
    units: dict[str, str] = {}
    content: list[str] = []
    count = [int(c == "#") for c in stream]
    whole = lambda x: content[ord(x) - _PLACE] if ord(x) >= _PLACE else x
    s = stream
    level = 0
    while level <= len(_REPEATS):
        if level < len(_REPEATS):
            places = [(m.start(), m.end(), len(m.group(1))) for m in _REPEATS[level].finditer(s)]
        else:
            places = long_repeats(s)
        out: list[str] = []
        n: list[int] = []
        last = 0
        for a, b, size in places:
            unit = s[a : a + size]
            if size == 1 and ord(unit) >= _PLACE:
                c = unit  # (x+)+ is x+
            else:
                c = units.get(unit)
                if c is None:
                    if len(content) == _PLACES:
                        break
                    c = units[unit] = chr(_PLACE + len(content))
                    content.append("(" + "".join(map(whole, unit)) + ")+")
            out.append(s[last:a])
            out.append(c)
            n += count[last:a]
            n.append(sum(count[a:b]))
            last = b
        if not last:
            level += 1
            continue
        out.append(s[last:])
        n += count[last:]
        s, count = "".join(out), n
        if level == len(_REPEATS):
            level = 0  # units that are now one item may be part of short ones
    return list(map(whole, s)), count


def items_of(expression: str) -> list[str]:
    """Top-level items of an expression without optional parts."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(expression):
        if c == "(":
            if not depth:
                start = k
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "+":
            if not depth:
                out.append(expression[start : k + 1])
        elif not depth:
            out.append(c)
    return out


@dataclass(frozen=True, slots=True)
class Item:
    """A part of a wrapper. low and high: range of the hashes of its texts on the
    pages that have it, None without texts; n: the number of those pages, copies
    included; least and most: range of the hashes of all their texts, which tells
    copies of one page from several pages."""

    what: str
    optional: bool = False
    low: int | None = None
    high: int | None = None
    n: int = 0
    least: int | None = None
    most: int | None = None

    @property
    def constant(self) -> bool:
        return self.least != self.most and self.low is not None and self.low == self.high


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, with rows of bits."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _range(lows: Iterable[int | None], highs: Iterable[int | None]) -> tuple[int | None, int | None]:
    return min((x for x in lows if x is not None), default=None), max((x for x in highs if x is not None), default=None)


def _fold(items: list[Item], unit: list[str], plus: str) -> list[Item]:
    """Single units become the repetition that the other side has."""
    what = [x.what for x in items]
    out, k, n = [], 0, len(unit)
    while k < len(items):
        if what[k : k + n] == unit:
            part = items[k : k + n]
            same = [x for x in part if x.low is not None]
            # one text keeps its range; several are compared no further
            low, high = (same[0].low, same[0].high) if len(same) == 1 else (None, None) if not same else (0, 1)
            out.append(Item(plus, any(x.optional for x in part), low, high, max(x.n for x in part), *_range((x.least for x in part), (x.most for x in part))))
            k += n
        else:
            out.append(items[k])
            k += 1
    return out


def _folded(a: list[Item], b: list[Item]) -> list[Item]:
    mine = {x.what for x in a}
    for plus in sorted({x.what for x in b if len(x.what) > 1} - mine, key=lambda s: (len(s), s)):
        unit = items_of(plus[1:-2])
        if unit[0] in mine:
            a = _fold(a, unit, plus)
    return a


def _inside(a: str, b: str) -> str | None:
    """Two repetitions at the same place as one, where most of their units agree."""
    if not (a.startswith("(") and b.startswith("(")) or "?" in a or "?" in b:
        return None
    x, y = items_of(a[1:-2]), items_of(b[1:-2])
    if 2 * len(common(x, y)) < min(len(x), len(y)):
        return None
    return "(" + expression(align([Item(t) for t in x], [Item(t) for t in y])) + ")+"


def _joined(a: Item, b: Item, what: str) -> Item:
    return Item(what, a.optional or b.optional, *_range((a.low, b.low), (a.high, b.high)), a.n + b.n, *_range((a.least, b.least), (a.most, b.most)))


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper that matches whatever one of the two matches."""
    a, b = _folded(a, b), _folded(b, a)
    out: list[Item] = []
    i = j = 0
    for p, q in [*common([x.what for x in a], [x.what for x in b]), (len(a), len(b))]:
        left, right = a[i:p], b[j:q]
        if len(left) == len(right) == 1 and (both := _inside(left[0].what, right[0].what)):
            out.append(_joined(left[0], right[0], both))
        else:
            out += [replace(x, optional=True) for x in (*left, *right)]
        if p < len(a):
            out.append(_joined(a[p], b[q], a[p].what))
        i, j = p + 1, q + 1
    return out


def expression(items: list[Item]) -> str:
    """Runs of optional items are one optional group."""
    out, run = [], []
    for x in [*items, None]:
        if x is not None and x.optional:
            run.append(x.what)
            continue
        if run:
            out.append("(" + "".join(run) + ")?")
            run = []
        if x is not None:
            out.append(x.what)
    return "".join(out)


def wrapper_of(shapes: list[list[Item]]) -> list[Item]:
    """Aligns shapes or wrappers: the widest spread first, then in a fixed order."""
    order = sorted(shapes, key=lambda s: (-max((x.n for x in s), default=0), len(s), [x.what for x in s]))
    out = order[0]
    for s in order[1:]:
        out = align(out, s)
    return out


def places(page: list[str], wrapper: list[Item]) -> list[int | None]:
    """For each item of a page's shape, its place in the wrapper."""
    at: list[int | None] = [None] * len(page)
    folded = _folded([Item(x, n=k) for k, x in enumerate(page)], wrapper)
    back: list[int] = []
    k = 0
    for x in folded:
        back.append(k)
        k += len(items_of(x.what[1:-2])) if len(x.what) > 1 and page[k] != x.what else 1
    inner = [x.what for x in wrapper]
    for i, j in common([x.what for x in folded], inner):
        at[back[i]] = j
    return at


# ---- over the table ------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and leading ``www.``; '' if none."""
    x = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(x), r"^www\.", ""), F.lit(""))


def _hash(texts: list[str]) -> int:
    h = xxhash.xxh64_intdigest("\0".join(texts).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _parsed(html: str) -> tuple[list[str], list[int], list[list[str]]]:
    """Items, texts in each, and those items' texts."""
    stream, texts = tokens(html)
    items, count = shape(stream)
    per, at = [], 0
    for c in count:
        per.append(texts[at : at + c])
        at += c
    return items, count, per


_FIELDS = ["items", "optional", "low", "high", "n", "least", "most"]
_SHAPES = "host string, salt int, items array<string>, optional array<boolean>, low array<bigint>, high array<bigint>, n array<bigint>, least array<bigint>, most array<bigint>"
_WRAPPERS = "host string, items array<string>, optional array<boolean>, low array<bigint>, high array<bigint>, n array<bigint>, least array<bigint>, most array<bigint>"


def _shape_batches(salts: int):
    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list] = {}
        size = 0
        for b in it:
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not html:
                    continue
                items, count, per = _parsed(html)
                if not items:
                    continue
                h = [_hash(t) if t else None for t in per]
                page = _hash([x for t in per for x in t])
                key = (host, "".join(items))
                old = seen.get(key)
                if old is None:
                    seen[key] = [items, h, list(h), 1, page, page]
                    size += len(items)
                else:
                    for k, x in enumerate(h):
                        if x is not None:
                            old[1][k], old[2][k] = min(old[1][k], x), max(old[2][k], x)
                    old[3] += 1
                    old[4], old[5] = min(old[4], page), max(old[5], page)
            if size > 1 << 20:  # bounds memory; the same shape may be sent again
                yield rows(seen)
                seen, size = {}, 0
        if seen:
            yield rows(seen)

    def rows(seen: dict) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(9)]
        for (host, key), (items, low, high, n, least, most) in seen.items():
            for c, v in zip(cols, (host, zlib.crc32(key.encode("utf-8", "surrogatepass")) % salts, items, [False] * len(items), low, high, [n] * len(items), [least] * len(items), [most] * len(items))):
                c.append(v)
        kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.bool_()), *[pa.list_(pa.int64())] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["host", "salt", *_FIELDS])

    return emit


def _items(row: dict) -> list[Item]:
    return [Item(*x) for x in zip(*(row[f] for f in _FIELDS))]


def _infer(t: pa.Table) -> pa.Table:
    once: dict[tuple, list[Item]] = {}
    for r in t.select(_FIELDS).to_pylist():
        s = _items(r)
        key = tuple((x.what, x.optional) for x in s)
        old = once.get(key)
        once[key] = s if old is None else [_joined(x, y, x.what) for x, y in zip(old, s)]
    w = wrapper_of(list(once.values())) if once else []
    return pa.table(
        {
            "host": t.column("host").slice(0, 1).cast(pa.string()),
            "items": pa.array([[x.what for x in w]], pa.list_(pa.string())),
            "optional": pa.array([[x.optional for x in w]], pa.list_(pa.bool_())),
            "low": pa.array([[x.low for x in w]], pa.list_(pa.int64())),
            "high": pa.array([[x.high for x in w]], pa.list_(pa.int64())),
            "n": pa.array([[x.n for x in w]], pa.list_(pa.int64())),
            "least": pa.array([[x.least for x in w]], pa.list_(pa.int64())),
            "most": pa.array([[x.most for x in w]], pa.list_(pa.int64())),
        }
    )


def infer_wrappers(pages: DataFrame, salts: int = 32) -> DataFrame:
    """One row per host: the items of its wrapper, whether each is optional, the
    range of its texts' hashes, and the pages that have it with their range."""
    shapes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_shape_batches(salts), _SHAPES)
    return shapes.groupBy("host", "salt").applyInArrow(_infer, _WRAPPERS).groupBy("host").applyInArrow(_infer, _WRAPPERS)


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers: dict[tuple, tuple[list[Item], bool]] = {}
    known: dict[tuple, list[bool]] = {}
    for b in it:
        slots, template, out = [], [], []
        hosts = b.column(1).to_pylist()
        cols = [b.column(k) for k in range(3, 3 + len(_FIELDS))]
        for k, (host, html) in enumerate(zip(hosts, b.column(2).to_pylist())):
            if html is None or not cols[0][k].is_valid:
                out.append(None if html is None else "")
                slots.append(0)
                template.append(0)
                continue
            got = wrappers.get(host)
            if got is None:
                w = [Item(*x) for x in zip(*(c[k].as_py() for c in cols))]
                got = wrappers[host] = w, any(x.low is not None and not x.constant for x in w)
            w, varies = got
            items, count, per = _parsed(html)
            key = (host, "".join(items))
            fixed = known.get(key)
            if fixed is None:
                if len(known) > 50_000:  # a cache, not a limit: it is filled again
                    known.clear()
                at = places(items, w)
                fixed = known[key] = [varies and p is not None and w[p].constant and w[p].what == x for p, x in zip(at, items)]
            kept = [t for f, t in zip(fixed, per) if not f]
            mine = [x for t in kept for x in t]
            slots.append(len(mine))
            template.append(sum(count) - len(mine))
            out.append("\n".join(mine))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(slots, pa.int32()), pa.array(template, pa.int32()), pa.array(out, pa.string())], ["page_id", "host", "n_slots", "n_template", "text"])


def extract_pages(pages: DataFrame, broadcast_bytes: int = 32 << 20, salts: int = 32) -> DataFrame:
    """page_id, host, n_slots (texts of data), n_template (texts of the wrapper),
    text (the data, a line each)."""
    pages = pages.select("page_id", "url", "html")
    wrappers = materialize(infer_wrappers(pages), "wrappers").withColumnRenamed("host", "w_host")
    keyed = pages.select("page_id", host_of(F.col("url")).alias("host"), "html")
    size = wrappers.agg(F.coalesce(F.sum(F.length(F.array_join("items", "")) + 64 * F.size("items")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        both = keyed.join(F.broadcast(wrappers), F.col("host") == F.col("w_host"), "left")
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(salts)))
        copies = wrappers.withColumn("w_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        both = keyed.join(copies, (F.col("host") == F.col("w_host")) & (F.col("salt") == F.col("w_salt")), "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return both.select("page_id", "host", "html", *_FIELDS).mapInArrow(_extract, f"page_id {kind}, host string, n_slots int, n_template int, text string")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
SQL: dict[str, str] = {}
