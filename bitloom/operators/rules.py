"""Queries of the conformance checks over the lifted segments.

On Spark they are the DataFrame expressions of ``validation``; the texts here are
written apart from those, in SQL, and state what DuckDB should find. A finding is
(sid, ord, check_id, severity, byte_offset)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitloom.operators import validation
from bitloom.plans.dialect import Template
from bitloom.session import materialize
from bitloom.sources.streams import REGIONS, TEXT, TYPES, emit_streams, parse_streams, segments

_REGION = "stype in (4, 6, 7, 20, 22, 23, 36, 38, 39, 40, 42, 43)"
_TEXT, _HALFTONE, _GENERIC, _REFINE = "stype in (4, 6, 7)", "stype in (20, 22, 23)", "stype in (36, 38, 39)", "stype in (40, 42, 43)"
_ARITH = "stype in (0, 6, 7, 38, 39, 42, 43)"

#: check id: (predicate, reported offset); several findings of one id are listed apart.
LOCAL: dict[str, list[tuple[str, str]]] = {
    "7.2.2-001": [("stype is null", "off + 4")],
    "7.2.3-001": [("form = 'Reserved'", "off + 5")],
    "7.2.4-001": [("retain <> $len(referred) + 1", "off + 5")],
    "7.2.7-001": [("data_length <> body_len", "off + hl - 4")],
    "7.2.7-002": [("data_length is null and (stype is null or stype not in (6, 7, 22, 23, 38, 39))", "off + hl - 4")],
    "7.4.1-001": [(f"{_REGION} and (rw = 0 or rh = 0)", "off + hl")],
    "7.4.1-002": [(f"{_REGION} and ((flags8 & 7) > 4 or (flags8 & 240) <> 0)", "off + hl + 16")],
    "7.4.2-001": [
        ("stype = 0 and ((flags16 & 57344) <> 0 or (flags16 & 12) = 8 or (flags16 & 48) = 32)", "off + hl"),
        ("stype = 0 and (flags16 & 1) = 1 and (flags16 & 3072) <> 0", "off + hl"),
        ("stype = 0 and (flags16 & 2) = 0 and (flags16 & 4096) <> 0", "off + hl"),
    ],
    "7.4.2-002": [("stype = 0 and (n_new = 0 or n_exp = 0)", "off + hl")],
    "7.4.3-001": [(f"{_TEXT} and (huff & 32768) <> 0", "off + hl + 19")],
    "7.4.3-002": [(f"{_TEXT} and n_inst = 0", "off + hl")],
    "7.4.4-001": [("stype = 16 and (flags8 & 248) <> 0", "off + hl"), ("stype = 16 and (rw = 0 or rh = 0)", "off + hl")],
    "7.4.5-001": [(f"{_HALFTONE} and (($shr[flags8,4] & 7) > 4 or gw = 0 or gh = 0)", "off + hl + 17")],
    "7.4.6-001": [(f"{_GENERIC} and ((flags8 & 224) <> 0 or ((flags8 & 17) <> 0 and (flags8 & 6) <> 0) or ((flags8 & 8) <> 0 and ($shr[flags8,1] & 3) > 1))", "off + hl + 17")],
    "7.4.7-001": [(f"{_REFINE} and (flags8 & 252) <> 0", "off + hl + 17")],
    "7.4.8-001": [("stype = 48 and (rw = 0 or rh = 0 or pflags is null)", "off + hl")],
    "7.4.12-001": [("stype = 52 and (body_len = 0 or body_len % 4 <> 0)", "off + hl")],
    "7.4.13-001": [("stype = 53 and body_len = 0", "off + hl")],
    "7.4.14-001": [("stype = 54 and body_len < 4", "off + hl")],
    "7.4.15-001": [("stype = 62 and body_len < 4", "off + hl")],
    "E.1.3-001": [(f"{_ARITH} and body_len = 0", "off + hl")],
    "A-001": [("stype = 0 and (n_new > 1000000 or n_exp > 1000000) or " + _TEXT + " and n_inst > 10000000", "off + hl")],
    "6.2.5.3-001": [(f"{_GENERIC} and body_len < (case when (flags8 & 1) = 1 then 18 when (flags8 & 6) = 0 and (flags8 & 16) <> 0 then 42 when (flags8 & 6) = 0 then 26 else 20 end)", "off + hl")],
}


def _select(check: str, source: str, where: str, at: str) -> str:
    return f"select sid, ord, 'T88-{check}' as check_id, 'Error' as severity, cast({at} as bigint) as byte_offset from {source} where {where}"


_BEFORE = "(select *, max(case when stype = 48 then 1 else 0 end) over (partition by sid, page order by ord rows between unbounded preceding and 1 preceding) as opened from seg) o"
_BAD_REF = "select r.sid, r.ord, 'T88-7.3.1-001' as check_id, 'Error' as severity, r.off as byte_offset from ref r left join (select distinct sid, number from seg) s on s.sid = r.sid and s.number = r.target where s.sid is null"


def _unresolved(check: str, where: str, targets: str) -> str:
    return f"""select g.sid, g.ord, 'T88-{check}' as check_id, 'Error' as severity, g.off as byte_offset from seg g left join
        (select distinct r.sid, r.ord from ref r join seg t on t.sid = r.sid and t.number = r.target and t.{targets}) k on k.sid = g.sid and k.ord = g.ord where g.{where} and k.sid is null"""


RELATED: dict[str, str] = {
    "7.2.1-001": _select("7.2.1-001", "(select *, lag(number) over (partition by sid order by ord) as before from seg) o", "number <= before", "off"),
    "7.3.1-001": _BAD_REF,
    "7.3.1-002": _select("7.3.1-002", "ref", "target >= number", "off"),
    "7.3.2-001": _select("7.3.2-001", _BEFORE, f"{_REGION} and page <> 0 and coalesce(opened, 0) = 0", "off"),
    "7.3.2-002": _unresolved("7.3.2-002", _TEXT, "stype = 0"),
    "7.4.2-009": """select sid, ord, 'T88-7.4.2-009' as check_id, 'Error' as severity, min(off) as byte_offset from ref where stype = 0 and (flags16 & 2) = 2 and target >= number group by sid, ord""",
    "7.4.7-002": _unresolved("7.4.7-002", _REFINE, "stype in (0, 4, 6, 7, 36, 38, 39)"),
    "7.4.9-001": """select p.sid, min(p.ord) as ord, 'T88-7.4.9-001' as check_id, 'Error' as severity, min(p.off) as byte_offset from seg p
        left join (select distinct sid, page from seg where stype = 49) e on e.sid = p.sid and e.page = p.page where p.stype = 48 and e.sid is null group by p.sid, p.page""",
    "7.4.11-001": _select("7.4.11-001", "(select *, lead(ord) over (partition by sid order by ord) as later from seg) o", "stype = 51 and later is not null", "off"),
}

def lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifted segments with the columns that the parser gives."""
    seg = Template("select * from seg", ("seg",)).spark(spark, sf_dir)
    is_in = lambda *types: F.col("stype").isin(*types)
    region = is_in(*REGIONS)
    when = lambda test, name: F.when(test, F.col(name))
    return seg.select(
        "sid", "ord", "off", "hl", "number", "stype", "form", "referred", "page", "data_length",
        F.array_repeat(F.lit(True), F.col("retain").cast("int")).alias("retain"),
        F.col("body_len").cast("int").alias("body_len"),
        when(region, "rw").alias("rw"), when(region, "rh").alias("rh"), when(region, "flags8").alias("rflags"),
        F.when(is_in(48), F.col("pflags")).otherwise(F.col("flags8")).alias("flags8"), "flags16", F.col("huff").alias("huff_flags"),
        when(is_in(0), "n_exp").alias("n_exp"), when(is_in(0), "n_new").alias("n_new"), when(is_in(*TEXT), "n_inst").alias("n_inst"),
        when(is_in(16), "rw").alias("pw"), when(is_in(16), "rh").alias("ph"), "gw", "gh",
        when(is_in(48), "rw").alias("page_width"), when(is_in(48), "rh").alias("page_height"),
    )


_KEYS = ("sid", "ord", "check_id", "severity", "byte_offset")


def _all(spark: SparkSession, sf_dir: str, lens: str = "strict") -> DataFrame:
    return validation.weighed(validation.findings(materialize(lifted(spark, sf_dir), "segments")), lens)


class Checked(Template):
    """A text for DuckDB and a function of (all findings, segments) for Spark."""

    def __init__(self, text: str, build: Callable[[SparkSession, str], DataFrame]):
        super().__init__(text, ("seg", "ref"))
        object.__setattr__(self, "build", build)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir)


def _rule(check: str) -> Callable[[SparkSession, str], DataFrame]:
    local = check in LOCAL

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        seg = lifted(spark, sf_dir)
        found = validation.local_findings(seg) if local else validation.sequence_findings(seg) if check in ("7.2.1-001", "7.3.2-001", "7.4.9-001", "7.4.11-001") else validation.reference_findings(seg)
        return found.where(F.col("check_id") == f"T88-{check}").select(*_KEYS)

    return build


def _report(*names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: validation.report(_all(spark, sf_dir, "itu"), lifted(spark, sf_dir)).select("sid", *names)


def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct(F.when(F.col("severity") == "Error", 0).otherwise(1).alias("s"), "byte_offset", "check_id"))
    return _all(spark, sf_dir).groupBy("sid").agg(first.alias("f")).select("sid", "f.check_id", "f.byte_offset")


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ("severity", "check_id", "segment_type")
    found = _all(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("sid", "ord", "byte_offset"))
    totals = found.groupBy(*key).agg(F.count("*").alias("total"))
    few = found.withColumn("k", rank).where("k <= 3")
    return few.join(totals, list(key)).select(*key, "sid", "ord", "k", "total")


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifted segments written as streams and parsed again."""
    rows = Template("select sid, ord, number, stype, page, referred, body_len from seg where stype is not null and stype <> 51 and number >= 0", ("seg",)).spark(spark, sf_dir)
    rows = rows.withColumn("body", F.repeat(F.lit("b"), F.col("body_len").cast("int")).cast("binary")).withColumn("referred", F.filter("referred", lambda r: (r >= 0) & ((r < 256) | (F.col("number") >= 256))))
    parsed = parse_streams(emit_streams(rows, "max(page)"))
    return segments(parsed).select("sid", "ord", "number", "stype", "page", F.array_join(F.transform("referred", lambda r: r.cast("string")), ",").alias("referred"), "off", "hl", F.length("body").cast("bigint").alias("body_len"), "form")


_duck_parts = [_select(check, "seg", w, at) for check, rules in LOCAL.items() for w, at in rules] + list(RELATED.values())
_findings = " union all ".join(_duck_parts)
_LENS = "case when check_id in ('T88-7.3.2-002', 'T88-7.4.2-009') then 'Warning' else severity end"
_NAME = "case g.stype " + " ".join(f"when {k} then '{v}'" for k, v in TYPES.items()) + " else 'Unknown' end"
_name = lambda check: f"rule_{check.replace('.', '_').replace('-', '_')}"
_errors, _warnings = "count(case when f.severity = 'Error' then 1 end)", "count(case when f.severity = 'Warning' then 1 end)"
_by_stream = f"(select distinct sid from seg) s left join (select sid, {_LENS} as severity, check_id, byte_offset from ({_findings}) g) f on f.sid = s.sid"
TEMPLATES: dict[str, Template] = {_name(k): Checked(" union all ".join(_select(k, "seg", w, at) for w, at in rules), _rule(k)) for k, rules in LOCAL.items()}
TEMPLATES |= {_name(k): Checked(t, _rule(k)) for k, t in RELATED.items()}
TEMPLATES |= {
    "stream_round_trip": Checked(
        """select sid, ord, number, stype, page, coalesce(array_to_string(refs, ','), '') as referred, cast(13 + sum(hl + body_len) over (partition by sid order by ord) - hl - body_len as bigint) as off, hl, body_len, case when n > 4 then 'Long' else 'Short' end as form
        from (select *, cast(6 + n * (case when number < 256 then 1 when number < 65536 then 2 else 4 end) + (case when page > 255 then 4 else 1 end) + 4 as bigint) as hl
          from (select sid, row_number() over (partition by sid order by ord) - 1 as ord, number, stype, page, body_len, list_filter(referred, lambda x: x >= 0 and (x < 256 or number >= 256)) as refs, len(list_filter(referred, lambda x: x >= 0 and (x < 256 or number >= 256))) as n from seg where stype is not null and stype <> 51 and number >= 0) a) b""",
        _round_trip,
    ),
    "validate": Checked(f"select * from ({_findings}) f", lambda spark, d: _all(spark, d).select(*_KEYS)),
    "lens_apply": Checked(f"select sid, ord, check_id, {_LENS} as severity, byte_offset from ({_findings}) f", lambda spark, d: _all(spark, d, "itu").select(*_KEYS)),
    "report_counts": Checked(f"select s.sid, {_errors} as errors, {_warnings} as warnings, {_errors} = 0 as ok, case when {_errors} > 0 then 'Error' when {_warnings} > 0 then 'Warning' end as highest from {_by_stream} group by s.sid", _report("errors", "warnings", "ok", "highest")),
    "report_cell_token": Checked(
        f"""select s.sid, case when {_errors} > 0 then concat('BAD(', {_errors}, '):', max(f3.ids)) when {_warnings} > 0 then concat('WARN(', {_warnings}, ')') else 'OK' end as cell
        from {_by_stream} left join (select sid, string_agg(check_id, ',' order by pos, check_id) as ids from (select *, row_number() over (partition by sid order by pos, check_id) as k
          from (select sid, check_id, min(byte_offset) as pos from (select sid, check_id, byte_offset, {_LENS} as severity from ({_findings}) g) h where severity = 'Error' group by sid, check_id) e) z
          where k <= 3 group by sid) f3 on f3.sid = s.sid group by s.sid""",
        _report("cell"),
    ),
    "report_primary": Checked(f"select sid, check_id, byte_offset from (select *, row_number() over (partition by sid order by case when severity = 'Error' then 0 else 1 end, byte_offset, check_id, ord) as k from ({_findings}) f) z where k = 1", _primary),
    "finding_buckets": Checked(f"""select severity, check_id, segment_type, sid, ord, k, total from (select *, row_number() over (partition by severity, check_id, segment_type order by sid, ord, byte_offset) as k, count(*) over (partition by severity, check_id, segment_type) as total
        from (select f.*, {_NAME} as segment_type from ({_findings}) f join seg g on g.sid = f.sid and g.ord = f.ord) n) z where k <= 3""", _buckets),
}
