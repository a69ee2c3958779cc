"""Conformance checks of streams, as expressions over segment rows.

``validate(streams, lens)`` parses and checks. Checks that look at one segment are
expressions of one scan; the others are windows and joins within a stream. All of
them take any DataFrame with the columns of ``sources.streams.SEGMENT``.

A finding is (sid, ord, check_id, severity, byte_offset, segment_number,
segment_type, message); ``report`` sums them up by stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitloom.session import materialize
from bitloom.sources.streams import GENERIC, HALFTONE, REFINEMENT, REGIONS, TEXT, TYPES, parse_streams, segments, type_name

#: By lens: checks whose findings are warnings.
LENSES: dict[str, tuple[str, ...]] = {
    "strict": (),
    "jbig2dec": ("T88-7.4.14-001",),
    "itu": ("T88-7.3.2-002", "T88-7.4.2-009"),
    "imageio": ("T88-7.4.14-001",),
}
BITMAP_SOURCES = (0, 4, 6, 7, 36, 38, 39)
UNKNOWN_LENGTH_TYPES = (6, 7, 22, 23, 38, 39)
ARITHMETIC = (0, 6, 7, 38, 39, 42, 43)

c = F.col
Rule = tuple[str, Column, Column, str]


def _bits(name: str, mask: int) -> Column:
    return c(name).bitwiseAND(mask) != 0


def _is(*types: int) -> Column:
    return c("stype").isin(*types)


def _local() -> list[Rule]:
    """(check, condition, byte offset, message) of what one segment shows."""
    start, data, length = c("off"), c("off") + c("hl"), c("off") + c("hl") - 4
    size = F.coalesce(c("body_len"), F.lit(0))
    region = c("rw").isNotNull()
    both = lambda test: c("n_exp").isNotNull() & c("n_new").isNotNull() & (test(c("n_exp")) | test(c("n_new")))
    shift = lambda name, k, mask: F.shiftright(name, k).bitwiseAND(mask)
    template = shift("flags8", 1, 3)
    needed = F.when(_bits("flags8", 1), 18).when((template == 0) & _bits("flags8", 16), 42).when(template == 0, 26).otherwise(20)
    sd, page = _is(0) & c("flags16").isNotNull(), _is(48)
    return [
        ("7.2.2-001", c("stype").isNull(), start + 4, "reserved or unknown segment type"),
        ("7.2.3-001", c("form") == "Reserved", start + 5, "reserved form of the reference count"),
        ("7.2.4-001", F.size("retain") != F.size("referred") + 1, start + 5, "retain bits don't match the references"),
        ("7.2.7-001", c("data_length") != size, length, "declared and present data length differ"),
        ("7.2.7-002", c("data_length").isNull() & ~F.coalesce(_is(*UNKNOWN_LENGTH_TYPES), F.lit(False)), length, "this type needs a data length"),
        ("7.4.1-001", region & ((c("rw") == 0) | (c("rh") == 0)), data, "a region of no area"),
        ("7.4.1-002", region & ((c("rflags").bitwiseAND(7) > 4) | _bits("rflags", 0xF0)), data + 16, "reserved region flags"),
        ("7.4.2-001", sd & (_bits("flags16", 0xE000) | (shift("flags16", 2, 3) == 2) | (shift("flags16", 4, 3) == 2)), data, "reserved symbol dictionary flags"),
        ("7.4.2-001", sd & _bits("flags16", 1) & _bits("flags16", 0xC00), data, "a template beside Huffman coding"),
        ("7.4.2-001", sd & ~_bits("flags16", 2) & _bits("flags16", 0x1000), data, "a refinement template without refinement"),
        ("7.4.2-002", sd & both(lambda n: n == 0), data, "no exported or no new symbols"),
        ("7.4.3-001", _is(*TEXT) & region & c("huff_flags").isNotNull() & _bits("huff_flags", 0x8000), data + 19, "reserved text Huffman flag"),
        ("7.4.3-002", _is(*TEXT) & (c("n_inst") == 0), data, "no symbol instances"),
        ("7.4.4-001", _is(16) & _bits("flags8", 0xF8), data, "reserved pattern dictionary flags"),
        ("7.4.4-001", _is(16) & ((c("pw") == 0) | (c("ph") == 0)), data, "patterns of no area"),
        ("7.4.5-001", _is(*HALFTONE) & region & c("flags8").isNotNull() & ((shift("flags8", 4, 7) > 4) | F.coalesce((c("gw") == 0) | (c("gh") == 0), F.lit(False))), data + 17, "bad halftone operator or grid"),
        (
            "7.4.6-001",
            _is(*GENERIC) & region & (_bits("flags8", 0xE0) | (_bits("flags8", 17) & (template != 0)) | (_bits("flags8", 8) & (template > 1))),
            data + 17,
            "reserved or contradicting generic region flags",
        ),
        ("7.4.7-001", _is(*REFINEMENT) & region & _bits("flags8", 0xFC), data + 17, "reserved refinement flags"),
        ("7.4.8-001", page & ((c("page_width") == 0) | (c("page_height") == 0) | c("flags8").isNull()), data, "page information cut off or of no area"),
        ("7.4.12-001", _is(52) & ((size == 0) | (size % 4 != 0)), data, "profiles are no sequence of four-byte values"),
        ("7.4.13-001", _is(53) & (size == 0), data, "an empty table"),
        ("7.4.14-001", _is(54) & (size < 4), data, "a colour palette without header"),
        ("7.4.15-001", _is(62) & (size < 4), data, "an extension without type"),
        ("E.1.3-001", _is(*ARITHMETIC) & (size == 0), data, "no arithmetic-coded data"),
        ("A-001", (sd & both(lambda n: n > 1_000_000)) | (_is(*TEXT) & (c("n_inst") > 10_000_000)), data, "an implausible count"),
        ("6.2.5.3-001", _is(*GENERIC) & region & c("flags8").isNotNull() & (size < needed), data, "no room for the adaptive pixels"),
    ]


def checks() -> list[str]:
    """The ids of all checks."""
    header, sequence = ["PARSE-001", "D.4-001", "D.4-002"], ["7.2.1-001", "7.3.2-001", "7.4.9-001", "7.4.11-001"]
    return sorted(f"T88-{x}" for x in (*header, *dict.fromkeys(r[0] for r in _local()), *sequence, "7.3.1-001", "7.3.1-002", "7.3.2-002", "7.4.2-009", "7.4.7-002"))


_OUT = ("sid", "ord", "check_id", "severity", "byte_offset", "segment_number", "segment_type", "message")


def _finding(check: Column | str, at: Column, message: Column | str) -> list[Column]:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[c("stype")], F.lit("Unknown"))
    return [c("sid"), c("ord").cast("bigint").alias("ord"), F.concat(F.lit("T88-"), text(check)).alias("check_id"), F.lit("Error").alias("severity"), at.cast("bigint").alias("byte_offset"), c("number").cast("bigint").alias("segment_number"), name.alias("segment_type"), text(message).alias("message")]


def slim(segs: DataFrame) -> DataFrame:
    """Segment rows with the length of the body in place of the body."""
    return segs if "body_len" in segs.columns else segs.withColumn("body_len", F.length("body")).drop("body")


def local_findings(segs: DataFrame) -> DataFrame:
    """All single-segment checks in one scan."""
    segs = slim(segs)
    hits = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(check).alias("check"), at.cast("bigint").alias("at"), F.lit(text).alias("text"))) for check, test, at, text in _local()])
    return segs.withColumn("hit", F.explode(F.filter(hits, lambda h: h.isNotNull()))).select(*_finding(c("hit.check"), c("hit.at"), c("hit.text")))


def sequence_findings(segs: DataFrame) -> DataFrame:
    """Checks of a stream's order: one shuffle by stream for all of them."""
    order = Window.partitionBy("sid").orderBy("ord")
    w = segs.withColumn("previous", F.lag("number").over(order)).withColumn("later", F.lead("ord").over(order))
    page_order = Window.partitionBy("sid", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("opened", F.max(F.when(_is(48), 1).otherwise(0)).over(page_order))
    w = w.withColumn("ended", F.max(F.when(_is(49), 1).otherwise(0)).over(Window.partitionBy("sid", "page")))
    rules = [
        ("7.2.1-001", c("number") <= c("previous"), c("off"), "segment numbers don't ascend"),
        ("7.3.2-001", c("rw").isNotNull() & ~F.coalesce(_is(48), F.lit(False)) & (c("page") != 0) & (F.coalesce("opened", F.lit(0)) == 0), c("off"), "a region before its page"),
        ("7.4.9-001", _is(48) & (F.coalesce("opened", F.lit(0)) == 0) & (c("ended") == 0), c("off"), "a page without end"),
        ("7.4.11-001", _is(51) & c("later").isNotNull(), c("off"), "segments after the end of the file"),
    ]
    hits = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(check).alias("check"), at.cast("bigint").alias("at"), F.lit(text).alias("text"))) for check, test, at, text in rules])
    return w.withColumn("hit", F.explode(F.filter(hits, lambda h: h.isNotNull()))).select(*_finding(c("hit.check"), c("hit.at"), c("hit.text")))


def references(segs: DataFrame) -> DataFrame:
    """A row per reference of each segment, in order: the place of the reference and
    the number referred to."""
    return segs.select("*", F.posexplode("referred").alias("at", "target")).drop("referred", "retain", "body")


def reference_findings(segs: DataFrame) -> DataFrame:
    refs = references(segs.select("sid", "ord", "number", "stype", "off", "flags16", "referred"))
    kinds = F.struct(F.lit(1).alias("there"), F.max(F.when(_is(0), 1).otherwise(0)).alias("symbols"), F.max(F.when(_is(*BITMAP_SOURCES), 1).otherwise(0)).alias("bitmap"))
    known = segs.groupBy("sid", c("number").alias("target")).agg(kinds.alias("k"))
    met = refs.join(known, ["sid", "target"], "left")
    missing = met.where("k is null").select(*_finding("7.3.1-001", c("off"), F.format_string("segment %d isn't there", "target")))
    forward = refs.where(c("target") >= c("number")).select(*_finding("7.3.1-002", c("off"), F.format_string("segment %d doesn't come before", "target")))
    aggregate = refs.where(_is(0) & (c("target") >= c("number")) & _bits("flags16", 2)).dropDuplicates(["sid", "ord"]).select(*_finding("7.4.2-009", c("off"), "aggregates of symbols that aren't there yet"))
    has = met.groupBy("sid", "ord").agg(F.max("k.symbols").alias("symbols"), F.max("k.bitmap").alias("bitmap"))
    asks = segs.where(_is(*TEXT) | (_is(*REFINEMENT) & c("rw").isNotNull())).select("sid", "ord", "number", "stype", "off").join(has, ["sid", "ord"], "left")
    text = asks.where(_is(*TEXT) & (F.coalesce("symbols", F.lit(0)) == 0)).select(*_finding("7.3.2-002", c("off"), "a text region without symbol dictionary"))
    refine = asks.where(_is(*REFINEMENT) & (F.coalesce("bitmap", F.lit(0)) == 0)).select(*_finding("7.4.7-002", c("off"), "a refinement of nothing"))
    return reduce(DataFrame.unionByName, [missing, forward, aggregate, text, refine])


def findings(segs: DataFrame) -> DataFrame:
    """All findings about segment rows."""
    return reduce(DataFrame.unionByName, [local_findings(segs), sequence_findings(segs), reference_findings(segs)])


def header_findings(parsed: DataFrame) -> DataFrame:
    """What the parser remarked, and the file header's checks."""
    said = parsed.select("sid", F.lit(None).alias("ord"), F.explode("diagnostics").alias("d")).select("sid", "ord", "d.*")
    remarks = said.select(*_finding("PARSE-001", c("off"), c("message")))
    # what belongs to no segment has no type either
    remarks = remarks.withColumn("segment_type", F.when(c("segment_number").isNotNull(), c("segment_type")))
    head = parsed.select("sid", "header", F.lit(None).alias("ord"), F.lit(None).alias("number"), F.lit(None).cast("int").alias("stype"))
    cols = lambda check, at, text: [*_finding(check, F.lit(at), text)[:6], F.lit(None).cast("string").alias("segment_type"), F.lit(text).alias("message")]
    flags = head.where(_bits("header.flags", 0xF0)).select(*cols("D.4-001", 8, "reserved file header flags"))
    pages = head.where("not header.unknown_pages and header.num_pages = 0").select(*cols("D.4-002", 9, "a file of no pages"))
    return reduce(DataFrame.unionByName, [remarks, flags, pages])


def validate(streams: DataFrame, lens: str = "strict", key: str = "sid", content: str = "content") -> DataFrame:
    """Findings of every stream under a lens, to be ordered by (byte_offset, check_id)."""
    parsed = parse_streams(streams, key, content)
    # several checks look at the same rows: streams are parsed once and bodies left behind
    light = F.transform("segments", lambda s: s.withField("body_len", F.length(s["body"])).dropFields("body"))
    parsed = materialize(parsed.withColumn("segments", light), "segments")
    return weighed(findings(segments(parsed)).unionByName(header_findings(parsed)), lens)


def weighed(found: DataFrame, lens: str = "strict") -> DataFrame:
    soft = LENSES[lens]
    severity = F.when(c("check_id").isin(*soft), "Warning").otherwise(c("severity")) if soft else c("severity")
    return found.withColumn("severity", severity).select(*_OUT)


def report(found: DataFrame, streams: DataFrame, key: str = "sid", ids: int = 3) -> DataFrame:
    """(sid, errors, warnings, highest, ok, cell) of every stream: the cell is
    ``OK``, ``WARN(n)`` or ``BAD(n):`` with the first ``ids`` different errors."""
    error = c("severity") == "Error"
    first = F.array_sort(F.collect_list(F.when(error, F.struct("byte_offset", "check_id"))))
    per = found.groupBy("sid").agg(F.count(F.when(error, 1)).alias("errors"), F.count(F.when(~error, 1)).alias("warnings"), first.alias("first"))
    all_ = streams.select(F.col(key).alias("sid")).distinct().join(per, "sid", "left").na.fill(0, ["errors", "warnings"])
    named = F.array_join(F.slice(F.array_distinct(F.col("first.check_id")), 1, ids), ",")
    cell = F.when(c("errors") > 0, F.concat(F.format_string("BAD(%d)", "errors"), F.lit(":" if ids else ""), named)).when(c("warnings") > 0, F.format_string("WARN(%d)", "warnings")).otherwise("OK")
    highest = F.when(c("errors") > 0, "Error").when(c("warnings") > 0, "Warning")
    return all_.select("sid", "errors", "warnings", highest.alias("highest"), (c("errors") == 0).alias("ok"), cell.alias("cell"))
