"""Suffix-array dedup of passages by a distributed, common-prefix-aware merge sort.

A passage is repeated where a window of ``min_words`` white-space words occurs
more than once in the corpus, in other documents or in the same one. Of each
repeated window the first occurrence, by (doc_id, word position), stays; the
union of all other windows is reported and removed.

1. Not every suffix can matter. Each window is anchored at the smallest hash of
   its ``gram``-word grams; equal windows have equal anchors, so sorting the
   suffixes that start at anchors loses nothing. Anchors whose gram occurs once
   in the corpus are dropped. (Hashes only select; text decides.)
2. Every task sorts its suffixes, cut to the ``min_words`` words that a window
   can reach, and writes one front-coded run per range of the suffix order: each
   entry holds the length of the prefix it shares with the entry before and the
   rest. Of equal suffixes of a run only the first document's goes on, so what a
   third of all documents share is one entry per run; the others point to it.
   Ranges come from sampled quantiles of the suffixes' first 48 bytes, with the
   gram's hash as tie-break: at most ``coarse_ranges`` of them, from a sample of
   bounded size, each cut further by the gram's hash where the corpus is large.
3. Each range merges its runs with a loser tree that carries, for every run's
   head, the length of the prefix shared with the last output. Heads with
   different lengths are ordered by those alone; equal ones are compared from
   that length on, so known prefixes are never compared again. The merge also
   yields the common prefix of neighbours, which delimits groups of equal grams,
   and in a group the windows themselves are compared.

Defined results: null, blank or shorter text has no window; rows without a
``doc_id`` are neither reported nor changed; rows that repeat both ``doc_id`` and
text are one document, with another text they are documents of their own, ordered
among themselves by a hash of the text; an empty table gives an empty result; other columns are ignored, and kept
by ``remove_repeated_passages``, which joins the words that remain with single
spaces, sets ``n_chars`` if there is such a column, and drops a document of which
nothing remains. Documents without a repeated passage stay as they are.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitloom.llm.textops import Words, integer_id, release, releasing, span_hash, text_key
from bitloom.session import materialize, table


@dataclass(frozen=True)
class SuffixRules:
    min_words: int = 50
    gram: int = 25
    #: Suffixes in a range of the merge; some 500 bytes each.
    range_suffixes: int = 30_000
    #: Of the range boundaries: one suffix in so many (by hash) is a candidate,
    #: and so many of those are used per coarse range. They affect balance alone.
    sampling: int = 64
    oversampling: int = 40
    coarse_ranges: int = 4096
    #: Bytes of suffixes that a task sorts at a time.
    run_bytes: int = 64 << 20


# ---- anchors -------------------------------------------------------------------


def anchored(w: Words, rules: SuffixRules) -> tuple[list[tuple[int, int, int]], np.ndarray, list[tuple[int, int, int, int]]]:
    """((anchor, first, last window), ...), gram hashes by word, and the runs of
    windows that repeat an earlier window of the same document, as (start, end,
    first and last of the windows they repeat).

    A document's own repeats are found here by comparing their text; only first
    occurrences have anchors. A run that repeats windows of several places is
    there once for each place."""
    n, m, g = len(w), rules.min_words, rules.gram
    if n < m:
        return [], np.zeros(0, np.uint64), []
    windows = np.arange(n - m + 1)
    wh = span_hash(w.h, w.s[windows], w.e[windows + m - 1])
    _, first, back = np.unique(wh, return_index=True, return_inverse=True)
    repeat = first[back] != windows
    if repeat.any():
        for p in np.flatnonzero(repeat):
            q = first[back[p]]
            if w.data[w.s[p] : w.e[p + m - 1]] != w.data[w.s[q] : w.e[q + m - 1]]:
                repeat[p] = False
    grams = span_hash(w.h, w.s[: n - g + 1], w.e[g - 1 :])
    at = windows + np.lib.stride_tricks.sliding_window_view(grams, m - g + 1).argmin(1)
    own: list[tuple[int, int, int, int]] = []
    if repeat.any():
        r = np.flatnonzero(repeat)
        cut = np.flatnonzero(np.diff(r) > 1) + 1
        for x in np.split(r, cut):
            q = np.unique(first[back[x]])
            for y in np.split(q, np.flatnonzero(np.diff(q) > 1) + 1):
                own.append((int(x[0]), int(x[-1]) + m, int(y[0]), int(y[-1])))
        windows, at = windows[~repeat], at[~repeat]
    cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(windows) != 1)) + 1
    lo, hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(at)]))
    return [(int(at[a]), int(windows[a]), int(windows[b - 1])) for a, b in zip(lo, hi)], grams, own


def _prefix(w: Words, a: int) -> bytes:
    """The first bytes of a suffix; no gram is shorter."""
    return w.data[w.s[a] : w.s[a] + 48]


_ANCHORS = "doc_id bigint, key bigint, gram bigint, place bigint, prefix binary, repeats bigint"
#: place: the anchor's word, its distance from the first window, and the number
#: of further windows, in one number.
_FIELD = 1 << 16
#: Of two word positions in one number.
_HALF = 1 << 31


def _anchor_batches(rules: SuffixRules):
    """Anchors as (doc_id, key, gram, place, prefix); the prefix only for the
    sampled ones. A document's own repeats have no gram; place then holds start
    and end, and ``repeats`` the first and last window that they repeat."""

    @releasing
    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = Words(t)
                anchors, grams, own = anchored(w, rules)
                if not anchors and not own:
                    continue
                h, gs = text_key(w.data), grams.view(np.int64).tolist()
                for a, p, q in anchors:
                    x = gs[a]
                    rows.append((i, h, x, (a * _FIELD + a - p) * _FIELD + q - p, None if x % rules.sampling else _prefix(w, a), None))
                rows += [(i, h, None, s * _HALF + e, None, a * _HALF + b) for s, e, a, b in own]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(),) * 4 + (pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "key", "gram", "place", "prefix", "repeats"])

    return emit


# ---- front coding and the loser tree --------------------------------------------


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(x), len(y))
    a, step = known, 16
    while a < n:
        b = min(a + step, n)
        p, q = x[a:b], y[a:b]
        if p != q:
            d = int.from_bytes(p, "big") ^ int.from_bytes(q, "big")
            return b - (d.bit_length() + 7) // 8
        a, step = b, step * 2
    return n


def front_code(run: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (suffix, payload): shared length, rest, payload."""
    out, prev = [], b""
    for s, payload in run:
        k = common_prefix(prev, s)
        out.append(struct.pack("<III", k, len(s) - k, len(payload)))
        out.append(s[k:])
        out.append(payload)
        prev = s
    return b"".join(out)


def front_decode(blob: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    at, prev = 0, b""
    while at < len(blob):
        k, n, m = struct.unpack_from("<III", blob, at)
        at += 12
        prev = prev[:k] + blob[at : at + n]
        at += n
        yield k, prev, blob[at : at + m]
        at += m


def merge_runs(runs: list[Iterator[tuple[int, bytes, bytes]]]) -> Iterator[tuple[int, bytes, bytes]]:
    """Merges front-coded runs with a loser tree; yields (prefix shared with the
    output before, suffix, payload)."""
    heads = [next(r, None) for r in runs]
    k = 1
    while k < len(runs):
        k *= 2
    heads += [None] * (k - len(runs))
    known = [0] * k

    def winner(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one shared with
        the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = known[a], known[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        s, t = x[1], y[1]
        n = common_prefix(s, t, p)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    tree = [0] * k  # losers at 1..k-1
    won = list(range(k))
    level = won
    first = k
    while len(level) > 1:
        first //= 2
        up = []
        for i in range(0, len(level), 2):
            a, b = winner(level[i], level[i + 1])
            tree[first + i // 2] = b
            up.append(a)
        level = up
    top = level[0]
    while heads[top] is not None:
        _, s, payload = heads[top]
        yield known[top], s, payload
        heads[top] = nxt = next(runs[top], None)
        known[top] = nxt[0] if nxt else 0
        node = (top + k) // 2
        while node:
            top, tree[node] = winner(top, tree[node])
            node //= 2


# ---- runs ------------------------------------------------------------------------

_HEAD = "<qqiiI"
_HEAD_SIZE = struct.calcsize(_HEAD)


_RUNS = "range bigint, run binary, doc_id bigint, key bigint, start bigint, end bigint, ref_doc bigint, ref_key bigint, low bigint, high bigint"


def _run_batches(rules: SuffixRules, bounds: list[tuple[bytes, int]], fine: int):
    """Runs by range; and the suffixes that equal another one of their run, as spans
    with the windows that they repeat."""
    m, g = rules.min_words, rules.gram

    @releasing
    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple[bytes, bytes, int, int], tuple[int, int, int]]] = {}
        same: list[tuple] = []
        size = 0
        for b in it:
            for i, text, anchors in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                w = Words(text)
                h = text_key(w.data)
                for x in anchors:
                    if x["key"] != h:
                        continue
                    rest, more = divmod(x["place"], _FIELD)
                    a, back = divmod(rest, _FIELD)
                    p = a - back
                    suffix = w.data[w.s[a] : w.e[p + more + m - 1]]
                    left = w.data[w.s[p] : w.s[a]]
                    gram = int(span_hash(w.h, w.s[a : a + 1], w.e[a + g - 1 : a + g]).view(np.int64)[0])
                    r = bisect_right(bounds, (_prefix(w, a), gram)) * fine + gram % fine
                    part = held.setdefault(r, {})
                    entry, me = (suffix, left, more, int(w.e[a + g - 1] - w.s[a])), (i, h, p)
                    first = part.setdefault(entry, me)
                    if first is me:
                        size += len(suffix) + len(left)
                    elif first != me:
                        part[entry] = min(first, me)
                        same.append((part, entry, max(first, me)))
            if size > rules.run_bytes or len(same) > 1 << 18:
                yield from _flush(held, same)
                held, same, size = {}, [], 0
        yield from _flush(held, same)

    def _flush(held: dict, same: list) -> Iterator[pa.RecordBatch]:
        """In batches of bounded size; what has been written is let go."""
        for at in range(0, len(same), _BATCH_SPANS):
            spans = []
            for part, entry, (i, h, p) in same[at : at + _BATCH_SPANS]:
                j, k, q = part[entry]
                spans.append((i, h, p, p + entry[2] + m, j, k, q, q + entry[2]))
            n = len(spans)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *(pa.array(c, pa.int64()) for c in zip(*spans))], _RUN_NAMES)
        same.clear()
        part = entry = None
        ids: list[int] = []
        runs: list[bytes] = []
        size = 0
        for r in sorted(held):
            run = front_code(sorted((suffix, struct.pack(_HEAD, *who, more, n) + left) for (suffix, left, more, n), who in held.pop(r).items()))
            if ids and size + len(run) > _BATCH_BYTES:
                yield _run_rows(ids, runs)
                ids, runs, size = [], [], 0
            ids.append(r)
            runs.append(run)
            size += len(run)
        if ids:
            yield _run_rows(ids, runs)

    return emit


_RUN_NAMES = [x.split()[0] for x in _RUNS.split(", ")]
#: Of an Arrow batch of runs, unless one run is longer, and of one of spans.
_BATCH_BYTES = 4 << 20
_BATCH_SPANS = 1 << 15


def _run_rows(ids: list[int], runs: list[bytes]) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, pa.binary()), *[pa.nulls(n, pa.int64())] * 8], _RUN_NAMES)
_SPANS = "doc_id bigint, key bigint, start bigint, end bigint, first_doc_id bigint"


def _settle(group: list[tuple[bytes, bytes]], m: int, out: list[tuple]) -> None:
    """Windows of suffixes that share their gram: all but the first occurrence of
    each are spans."""
    if len(group) < 2:
        return
    first: dict[bytes, tuple[int, int, int]] = {}
    keyed = []
    for suffix, payload in group:
        i, h, p, more, _ = struct.unpack_from(_HEAD, payload)
        full = payload[_HEAD_SIZE :] + suffix
        gaps = np.flatnonzero(np.frombuffer(full, np.uint8) == 32).tolist()
        starts, ends = [0, *[x + 1 for x in gaps]], [*gaps, len(full)]
        mine = [full[starts[k] : ends[k + m - 1]] for k in range(more + 1)]
        keyed.append((i, h, p, mine))
        for k, key in enumerate(mine):
            at = first.get(key)
            if at is None or (i, h, p + k) < at:
                first[key] = (i, h, p + k)
    for i, h, p, mine in keyed:
        start = None
        for k, key in enumerate(mine):
            own = first[key]
            if own != (i, h, p + k):
                if start is not None and source != own[0]:  # a span has one source
                    out.append((i, h, start, p + k - 1 + m, source))
                    start = None
                if start is None:
                    start, source = p + k, own[0]
            elif start is not None:
                out.append((i, h, start, p + k - 1 + m, source))
                start = None
        if start is not None:
            out.append((i, h, start, p + len(mine) - 1 + m, source))


def _merge_range(rules: SuffixRules):
    def merge(t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        group: list[tuple[bytes, bytes]] = []
        gram = b""
        for lcp, suffix, payload in merge_runs([front_decode(x.as_py()) for x in t.column("run")]):
            n = struct.unpack_from(_HEAD, payload)[4]
            if group and n == len(gram) and lcp >= n:
                group.append((suffix, payload))
            else:
                _settle(group, rules.min_words, out)
                group, gram = [(suffix, payload)], suffix[:n]
        _settle(group, rules.min_words, out)
        cols = list(zip(*out)) if out else [[]] * 5
        release()
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "key", "start", "end", "first_doc_id"), cols)})

    return merge


def _spans(docs: DataFrame, rules: SuffixRules) -> DataFrame:
    if not 0 < rules.gram <= rules.min_words < _FIELD:
        raise ValueError("a gram must fit into a window")
    docs = docs.where("doc_id is not null and text is not null").select(integer_id(docs, "doc_id"), "text")
    found = docs.mapInArrow(_anchor_batches(rules), _ANCHORS)
    # the documents' own repeats have no gram; they are spread by document
    place = F.coalesce("gram", "doc_id")
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy(place, F.col("gram").isNull())))
    anchors = materialize(counted.where("gram is null or n > 1").select("doc_id", "key", F.col("gram").isNull().alias("own"), "gram", "place", "prefix", "repeats"), "suffix-anchors")
    half = lambda c, k: F.expr(f"{c} div {_HALF}L" if k == 0 else f"{c} % {_HALF}L")
    repeats = ("doc_id", "key", "start", "end", "ref_doc", "ref_key", "low", "high")
    own = anchors.where("own").select("doc_id", "key", half("place", 0).alias("start"), half("place", 1).alias("end"), F.col("doc_id").alias("ref_doc"), F.col("key").alias("ref_key"), half("repeats", 0).alias("low"), half("repeats", 1).alias("high"))
    alive = anchors.where("not own")
    n, sampled = alive.agg(F.count("*"), F.count("prefix")).first()
    ranges = max(1, round(n / rules.range_suffixes))
    coarse = min(ranges, rules.coarse_ranges)
    share = min(1.0, coarse * rules.oversampling / max(1, sampled))
    # at most coarse_ranges * oversampling prefixes, whatever the corpus
    sample = sorted((bytes(r.prefix), r.gram) for r in alive.where("prefix is not null").select("prefix", "gram").sample(share, 1).collect()) if coarse > 1 else []
    bounds = sorted({sample[len(sample) * k // coarse] for k in range(1, coarse)}) if sample else []
    by_doc = alive.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place")).alias("anchors"))
    runs = materialize(docs.join(by_doc, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_run_batches(rules, bounds, -(-ranges // coarse)), _RUNS), "suffix-runs")
    merged = materialize(runs.where("range is not null").select("range", "run").groupBy("range").applyInArrow(_merge_range(rules), _SPANS), "suffix-merged")
    same = runs.where("range is null").select(*repeats)
    return _islands(merged.union(_sourced(own.unionByName(same), merged, rules)))


def _sourced(own: DataFrame, merged: DataFrame, rules: SuffixRules) -> DataFrame:
    """Spans that repeat windows (``low`` to ``high``) of a document, with the source
    found for those: the document itself where they are the first ones of the corpus."""
    found = merged.select(F.col("doc_id").alias("i"), F.col("key").alias("k"), F.col("start").alias("s"), (F.col("end") - rules.min_words).alias("e"), "first_doc_id")
    same = (F.col("ref_doc") == F.col("i")) & (F.col("ref_key") == F.col("k")) & (F.col("low") <= F.col("e")) & (F.col("high") >= F.col("s"))
    return own.join(found, same, "left").groupBy("doc_id", "key", "start", "end").agg(F.min(F.coalesce("first_doc_id", "ref_doc")).alias("first_doc_id"))


def repeated_passages(docs: DataFrame, rules: SuffixRules = SuffixRules()) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, first_doc_id: the words
    of each document that repeat an earlier passage; first_doc_id is the smallest
    document that holds the first occurrence of one of its windows."""
    return _spans(docs, rules).drop("key")


def _islands(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a document become one."""
    w = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = island.groupBy("doc_id", "key", "island").agg(F.min("start").cast("int").alias("start_word"), F.max("end").cast("int").alias("end_word"), F.min("first_doc_id").alias("first_doc_id"))
    return out.select("doc_id", "key", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


@releasing
def _cut_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        t = b.schema.get_field_index("text")
        s = b.schema.get_field_index("__spans")
        out = []
        for text, spans in zip(b.column(t).to_pylist(), b.column(s).to_pylist()):
            w = Words(text)
            mine = [x for x in spans if text and x["key"] == text_key(w.data)]
            for x in sorted(mine, key=lambda x: -x["start_word"]):
                del w.words[x["start_word"] : x["end_word"]]
            out.append(" ".join(w.words) if mine else text)
        cols = [pa.array(out, pa.string()) if k == t else c for k, c in enumerate(b.columns) if k != s]
        yield pa.RecordBatch.from_arrays(cols, [n for k, n in enumerate(b.schema.names) if k != s])


def remove_repeated_passages(docs: DataFrame, rules: SuffixRules = SuffixRules()) -> DataFrame:
    """``docs`` without the passages that repeat an earlier one."""
    spans = materialize(_spans(docs, rules).groupBy("doc_id").agg(F.collect_list(F.struct("key", "start_word", "end_word")).alias("__spans")), "suffix-spans")
    hit = docs.join(spans, "doc_id", "left")
    same = hit.where("__spans is null").drop("__spans")
    cut = hit.where("__spans is not null").select(*docs.columns, "__spans").mapInArrow(_cut_batches, docs.schema).where("text is null or text <> ''")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.select(*docs.columns).unionByName(cut.select(*docs.columns))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
SQL = {
    "op5_suffix_dedup": r"""
    with d as (select doc_id, min(text) t from documents where doc_id is not null and text is not null group by doc_id),
    w as (select doc_id, list_filter(string_split_regex(t, '\s+'), lambda x: x <> '') ws from d),
    p as (select doc_id, ws, unnest(range(len(ws) - 49))::integer p from w where len(ws) >= 50),
    k as (select doc_id, p, md5(array_to_string(ws[p + 1 : p + 50], ' ')) k from p),
    f as (select doc_id, p, first_value(doc_id) over o fd, first_value(p) over o fp from k window o as (partition by k order by doc_id, p)),
    r as (select doc_id, p, fd from f where doc_id <> fd or p <> fp),
    g as (select *, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end new from r),
    i as (select *, sum(new) over (partition by doc_id order by p) island from g)
    select doc_id, min(p)::integer start_word, (max(p) + 50)::integer end_word, (max(p) + 50 - min(p))::integer n_words, min(fd) first_doc_id from i group by doc_id, island
    """
}
