"""Quality rules by distribution divergence.

Each document gets two histograms: its characters by class, and its words by
membership in a fixed list of common words (one bin per word, one bin for every
other word). Both are compared with the reference of the document's language by
the Jensen-Shannon distance (base 2, so within [0, 1]). The references are sums
over all documents of that language, so a language of which most text is junk has
junk as its norm. Minimum-length guards keep a histogram of
too few observations from deciding anything.

Defined results:

* null text, or text without words: both distances null where there is nothing to
  compare, verdict ``keep = false`` (``reason = 'empty'``)
* very long texts are counted whole
* a distance above its bound, ``base + slack / sqrt(n)``, rejects the document
* fewer than ``min_chars`` characters or ``min_words`` words: the distance is
  reported but does not decide
* null language: its own reference group
* repeated rows are judged like any other row, once per row
* ``doc_id`` may be of any type; other columns are ignored by ``quality_scores`` and
  kept by ``quality_filter``, whatever their names
* a language whose reference holds fewer than ``min_reference_words`` words
  decides nothing
* an empty table gives an empty result
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from bitloom.llm.textops import Words, fresh, releasing
from bitloom.session import materialize, table

CHAR_CLASSES = ("lower", "upper", "letter", "digit", "space", "punct", "symbol", "other")

#: The most common function words of the languages served; a bin each.
COMMON_WORDS = tuple(
    sorted(
        set(
            "the of and to in a is that for it was on are as with by be this at from or have an they which not but had his her"
            " de la le les et des en un une du que est pour qui dans par sur pas avec au ce il ne se plus son"
            " der die und das den von zu mit im für auf ist nicht ein eine dem des es sich auch als an wird aus"
            " el los y del las por con para se al lo como más su sus no una o pero".split()
        )
    )
)


@dataclass(frozen=True)
class QualityRules:
    """A histogram of n observations strays from its reference by about
    1/sqrt(n) even in a clean document, so each bound is ``base + slack /
    sqrt(n)``."""

    char_base: float = 0.12
    char_slack: float = 2.2
    word_base: float = 0.23
    word_slack: float = 2.2
    min_chars: int = 200
    min_words: int = 48
    min_reference_words: int = 500


def char_class(cp: int) -> int:
    """Class index of a code point; the classes partition all code points."""
    c = unicodedata.category(chr(cp))
    if chr(cp) in " \t\n\r\f\v" or c[0] == "Z":
        return 4
    return {"Ll": 0, "Lu": 1}.get(c, {"L": 2, "N": 3, "P": 5, "S": 6}.get(c[0], 7))


@lru_cache(1)
def _class_table() -> np.ndarray:
    t = np.full(0x110000, 255, np.uint8)
    t[:0x3000] = [char_class(i) for i in range(0x3000)]
    return t


def _classes(text: str) -> np.ndarray:
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    t = _class_table()
    k = t[cps]
    if (k == 255).any():  # rare planes are classified when first seen
        for cp in np.unique(cps[k == 255]):
            t[cp] = char_class(int(cp))
        k = t[cps]
    return np.bincount(k, minlength=len(CHAR_CLASSES))


def _eight(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Byte strings of at most eight bytes as integers, padded with zeros."""
    n = e - s
    at = np.arange(8)
    inside = at < n[:, None]
    return np.where(inside, b[np.minimum(s[:, None] + at, len(b) - 1)], np.uint8(0)).view(np.uint64).ravel()


@lru_cache(1)
def _common() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common words as sorted integers, their places and lengths."""
    words = [w.encode() for w in COMMON_WORDS]
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size)
    x = _eight(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)
    order = np.argsort(x)
    return x[order], order, size[order]


_KEEP_BYTES = np.ones(256, bool)
_KEEP_BYTES[[ord(c) for c in ".,"]] = False


def _word_bins(text: str) -> np.ndarray:
    """Counts of lower-cased words, one trailing full stop or comma removed."""
    w = Words(text.lower())
    out = np.zeros(len(COMMON_WORDS) + 1, np.int64)
    if not len(w):
        return out
    e = w.e - ((w.e - w.s > 1) & ~_KEEP_BYTES[w.b[w.e - 1]])
    common, order, size = _common()
    x = _eight(w.b, w.s, e)
    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
    hit = (common[at] == x) & (size[at] == e - w.s)
    out[: len(common)] = np.bincount(order[at[hit]], minlength=len(common))
    out[-1] = len(w) - hit.sum()
    return out


_HIST = "struct<n_chars:bigint,n_words:bigint,chars:array<bigint>,words:array<bigint>>"


def _histogram_batches(text: int, keep: list[int], name: str):
    @releasing
    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(text).to_pylist()
            chars = [_classes(t or "") for t in texts]
            words = [_word_bins(t or "") for t in texts]
            size = lambda rows: pa.array([int(x.sum()) for x in rows], pa.int64())
            lists = lambda rows: pa.array(rows, pa.list_(pa.int64()))
            q = pa.StructArray.from_arrays([size(chars), size(words), lists(chars), lists(words)], ["n_chars", "n_words", "chars", "words"])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], q], [*[b.schema.names[k] for k in keep], name])

    return emit


def histograms(docs: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``columns`` and, as struct ``name``, the character-class and common-word
    counts of each document, in one scan."""
    kept = [docs.schema[c] for c in columns]
    schema = StructType([*kept, StructField(name, _parse_datatype_string(_HIST))])
    return docs.mapInArrow(_histogram_batches(docs.columns.index("text"), [docs.columns.index(c) for c in columns], name), schema)


def _plogp(p: Column, q: Column) -> Column:
    """p * log2(p / m) with m the mean of p and q; 0 where p is 0."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def js_distance(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """Jensen-Shannon distance of two count arrays, given their totals as stored
    columns (a total computed here would be evaluated once per bin); null where
    either is empty."""
    terms = F.zip_with(a, b, lambda x, y: _plogp(x / na, y / nb) + _plogp(y / nb, x / na))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when((na > 0) & (nb > 0), F.sqrt(F.greatest(total, F.lit(0.0)) / 2))


def references(hist: DataFrame, q: str) -> DataFrame:
    """One row per language: both histograms summed over all its documents."""
    sums = lambda c, n: F.array(*[F.sum(F.col(f"{q}.{c}")[i]) for i in range(n)])
    return hist.groupBy(F.col("lang").alias("lang")).agg(
        F.sum(f"{q}.n_chars").alias("n_chars"),
        F.sum(f"{q}.n_words").alias("n_words"),
        sums("chars", len(CHAR_CLASSES)).alias("chars"),
        sums("words", len(COMMON_WORDS) + 1).alias("words"),
    )


#: Up to so many languages (1.4 KB each) their references are broadcast.
_FEW_LANGUAGES = 4096


def _judged(hist: DataFrame, q: str, ref: DataFrame, rules: QualityRules) -> DataFrame:
    """``hist`` with a struct ``q`` of sizes, distances and the reason."""
    r = fresh(hist, "r")
    ref = ref.select(F.col("lang").alias(f"{r}_lang"), F.struct("n_chars", "n_words", "chars", "words").alias(r))
    if ref.count() <= _FEW_LANGUAGES:
        ref = F.broadcast(ref)
    j = hist.join(ref, F.col("lang").eqNullSafe(F.col(f"{r}_lang")), "left")
    x = lambda f: F.col(f"{q}.{f}")
    y = lambda f: F.col(f"{r}.{f}")
    d = fresh(j, "d")
    both = F.struct(*[F.round(js_distance(x(c), x(f"n_{c}"), y(c), y(f"n_{c}")), 6).alias(c) for c in ("chars", "words")])
    j = j.withColumn(d, both)
    enough = y("n_words") >= rules.min_reference_words
    over = lambda what: F.col(f"{d}.{what}s") > getattr(rules, f"{what}_base") + getattr(rules, f"{what}_slack") / F.sqrt(x(f"n_{what}s"))
    reason = (
        F.when(x("n_words") == 0, "empty")
        .when(enough & (x("n_chars") >= rules.min_chars) & over("char"), "characters")
        .when(enough & (x("n_words") >= rules.min_words) & over("word"), "words")
        .otherwise("ok")
    )
    return j.withColumn(q, F.struct(x("n_chars").alias("n_chars"), x("n_words").alias("n_words"), F.col(f"{d}.chars").alias("char_distance"), F.col(f"{d}.words").alias("word_distance"), reason.alias("reason"))).drop(r, d, f"{r}_lang")


def quality_scores(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: sizes, both distances, verdict and its reason."""
    hist = materialize(histograms(docs.select("doc_id", "lang", "text"), ["doc_id", "lang"], "q"), "quality-hist")
    ref = materialize(references(hist, "q"), "quality-references")
    return _judged(hist, "q", ref, rules).select("doc_id", "lang", "q.*", (F.col("q.reason") == "ok").alias("keep"))


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows that the rules keep, with all their columns.

    Each row is judged by its own text, where it lies: a second scan takes the
    place of a shuffle of the texts, so rows without ``doc_id`` or with another
    row's are judged like any other."""
    q = fresh(docs, "q")
    ref = materialize(references(histograms(docs.select("lang", "text"), ["lang"], "q"), "q"), "quality-references")
    return _judged(histograms(docs, docs.columns, q), q, ref, rules).where(F.col(f"{q}.reason") == "ok").select(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))


def _sql() -> str:
    r = QualityRules()
    cls = {
        "lower": r"[^\p{Ll}]",
        "upper": r"[^\p{Lu}]",
        "letter": r"[^\p{Lt}\p{Lm}\p{Lo}]",
        "digit": r"[^\p{N}]",
        "space": r"[^ \t\n\r\f\x0B\p{Z}]",
        "punct": r"[^\p{P}]",
        "symbol": r"[^\p{S}]",
    }
    counted = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g')) c{i}" for i, p in enumerate(cls.values()))
    n = len(cls)
    values = ", ".join(f"('{w}')" for w in COMMON_WORDS)
    return f"""
    with d as (select doc_id, lang, coalesce(text, '') t, row_number() over () rid from documents),
    c0 as (select rid, doc_id, lang, length(t) n_chars, {counted} from d),
    cl as (select rid, lang, n_chars, unnest([{", ".join(f"c{i}" for i in range(n))}, n_chars - {" - ".join(f"c{i}" for i in range(n))}]) x, unnest(range({n + 1})) k from c0),
    cr as (select lang, k, sum(x) x from cl group by all), ct as (select lang, sum(x) n from cr group by lang),
    cj as (select rid, sqrt(greatest(sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end), 0) / 2) dist
        from (select cl.rid, cl.x / cl.n_chars::double p, cr.x / ct.n::double q from cl join cr on cl.lang is not distinct from cr.lang and cl.k = cr.k join ct on cl.lang is not distinct from ct.lang where cl.n_chars > 0) group by rid),
    v as (select * from (values {values}) v(w)),
    ws as (select rid, lang, unnest(list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> '')) w from d),
    wk as (select rid, lang, case when length(w) > 1 and w[-1] in ('.', ',') then w[:-2] else w end w from ws),
    wc as (select rid, lang, coalesce(v.w, '') w, count(*) x from wk left join v on wk.w = v.w group by all),
    wn as (select rid, lang, sum(x) n from wc group by all),
    wr as (select lang, w, sum(x) x from wc group by all), wt as (select lang, sum(x) n from wr group by all),
    wp as (select wn.rid, wr.x / wt.n::double q, coalesce(wc.x, 0) / wn.n::double p from wn join wt on wn.lang is not distinct from wt.lang join wr on wn.lang is not distinct from wr.lang
        left join wc on wc.rid = wn.rid and wc.w = wr.w),
    wj as (select rid, sqrt(greatest(sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end), 0) / 2) dist from wp group by rid),
    s as (select c0.doc_id, c0.lang, c0.n_chars, coalesce(wn.n, 0)::bigint n_words, round(cj.dist, 6) char_distance, round(wj.dist, 6) word_distance, coalesce(wt.n, 0) >= {r.min_reference_words} enough
        from c0 left join cj using (rid) left join wn using (rid) left join wj using (rid) left join wt on c0.lang is not distinct from wt.lang),
    z as (select *, case when n_words = 0 then 'empty' when enough and n_chars >= {r.min_chars} and char_distance > {r.char_base} + {r.char_slack} / sqrt(n_chars) then 'characters'
        when enough and n_words >= {r.min_words} and word_distance > {r.word_base} + {r.word_slack} / sqrt(n_words) then 'words' else 'ok' end reason from s)
    select doc_id, lang, n_chars, n_words, char_distance, word_distance, reason, reason = 'ok' as keep from z
    """


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL = {"op2_quality_rules": _sql()}
