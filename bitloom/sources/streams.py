"""Segment-structured streams (ITU-T T.88 clause 7 and annex D) as DataFrames.

``open_streams`` lists files as (sid, content); any DataFrame with a key and a binary
column will do as well. ``parse_streams`` turns each stream into one row with its
file header, its segments and what the parser had to say; ``segments`` and
``diagnostics`` are those arrays as rows. Parsing is byte-serial within a stream and
independent between streams, so it is one Arrow pass without a shuffle.

The parser is tolerant: it keeps reserved and unknown values and stops only where it
can't tell where the next segment begins. ``strict_errors`` names the streams that a
strict reader refuses, and why.

``emit_streams`` is the way back: a row per segment becomes header bytes and body in
one pass, and a stream is put together by the order of its segments.

Defined results: a null stream has no header, no segments and no diagnostics; an
empty one is shorter than the ID string, which is its only diagnostic.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StructType, _parse_datatype_string

MAGIC = bytes((0x97, 0x4A, 0x42, 0x32, 0x0D, 0x0A, 0x1A, 0x0A))

TYPES = {
    0: "SymbolDictionary",
    4: "IntermediateTextRegion",
    6: "ImmediateTextRegion",
    7: "ImmediateLosslessTextRegion",
    16: "PatternDictionary",
    20: "IntermediateHalftoneRegion",
    22: "ImmediateHalftoneRegion",
    23: "ImmediateLosslessHalftoneRegion",
    36: "IntermediateGenericRegion",
    38: "ImmediateGenericRegion",
    39: "ImmediateLosslessGenericRegion",
    40: "IntermediateGenericRefinementRegion",
    42: "ImmediateGenericRefinementRegion",
    43: "ImmediateLosslessGenericRefinementRegion",
    48: "PageInformation",
    49: "EndOfPage",
    50: "EndOfStripe",
    51: "EndOfFile",
    52: "Profiles",
    53: "Tables",
    54: "ColourPalette",
    62: "Extension",
}
TEXT, HALFTONE, GENERIC, REFINEMENT = (4, 6, 7), (20, 22, 23), (36, 38, 39), (40, 42, 43)
REGIONS = TEXT + HALFTONE + GENERIC + REFINEMENT
UNKNOWN_LENGTH = 0xFFFFFFFF

#: What a segment's body says, by the names used below; null where it doesn't.
BODY_FIELDS = "rw bigint, rh bigint, rx bigint, ry bigint, rflags int, flags8 int, flags16 int, huff_flags int, n_exp bigint, n_new bigint, n_inst bigint, pw int, ph int, gray_max bigint, gw bigint, gh bigint, page_width bigint, page_height bigint, stripe int"
SEGMENT = f"ord bigint, off bigint, hl bigint, number bigint, flags int, stype int, form string, deferred boolean, page32 boolean, referred array<bigint>, retain array<boolean>, page bigint, data_length bigint, body binary, {BODY_FIELDS}"
HEADER = "flags int, sequential boolean, unknown_pages boolean, num_pages bigint, first_segment bigint"
DIAGNOSTIC = "off bigint, number bigint, stype int, message string"
_BODY_NAMES = [x.split()[0] for x in BODY_FIELDS.split(", ")]


def _be(data: bytes, at: int, n: int) -> int | None:
    part = data[at : at + n]
    return int.from_bytes(part, "big") if len(part) == n else None


def region_of(body: bytes) -> dict | None:
    if len(body) < 17:
        return None
    return dict(zip(("rw", "rh", "rx", "ry", "rflags"), struct.unpack_from(">4IB", body)))


def body_of(stype: int | None, body: bytes) -> dict:
    """The fields of a segment's data header."""
    if stype == 0:
        flags = _be(body, 0, 2)
        if flags is None:
            return {}
        at = 2 + (0 if flags & 1 else 8 if flags & 0xC00 == 0 else 2) + (4 if flags & 2 and not flags & 0x1000 else 0)
        return {"flags16": flags, "n_exp": _be(body, at, 4), "n_new": _be(body, at + 4, 4)}
    if stype == 16:
        return {"flags8": body[0] if body else 0, "pw": _be(body, 1, 1), "ph": _be(body, 2, 1), "gray_max": _be(body, 3, 4)}
    if stype == 48:
        return {"page_width": _be(body, 0, 4), "page_height": _be(body, 4, 4), "flags8": _be(body, 16, 1), "stripe": _be(body, 17, 2)}
    if stype in (52, 53, 54, 62):
        return {}
    out = region_of(body)
    if out is None:
        return {}
    if stype in TEXT:
        flags = _be(body, 17, 2)
        out["flags16"] = flags or 0
        if flags is not None:
            at = 19
            if flags & 1:
                out["huff_flags"] = _be(body, at, 2)
                at += 2
            out["n_inst"] = _be(body, at + (4 if flags & 2 and not flags & 0x8000 else 0), 4)
    elif stype in HALFTONE:
        out |= {"flags8": _be(body, 17, 1), "gw": _be(body, 18, 4), "gh": _be(body, 22, 4)}
    elif stype in GENERIC + REFINEMENT:
        out["flags8"] = _be(body, 17, 1)
    return out


class Parser:
    """One stream, front to back."""

    def __init__(self, data: bytes):
        self.data = data
        self.header: dict | None = None
        self.segments: list[dict] = []
        self.said: list[dict] = []
        at = self.file_header()
        if self.header is not None:
            self.header["first_segment"] = at
        while at < len(data):
            at = self.segment(at)
            if at is None or self.segments[-1]["stype"] == 51:
                break

    def say(self, off: int, message: str, number: int | None = None, stype: int | None = None) -> None:
        self.said.append({"off": off, "number": number, "stype": stype, "message": message})

    def file_header(self) -> int:
        d = self.data
        if len(d) < 8:
            self.say(0, "the stream ends within the ID string")
            return len(d)
        if d[:8] != MAGIC:
            self.say(0, "the stream doesn't begin with the ID string")
            return 0
        if len(d) < 9:
            self.say(8, "no file header flags")
            return len(d)
        pages = None
        end = 9
        if not d[8] & 2:
            pages = _be(d, 9, 4)
            end = 13
            if pages is None:
                self.say(9, "the number of pages is cut off")
                end = len(d)
        self.header = {"flags": d[8], "sequential": bool(d[8] & 1), "unknown_pages": bool(d[8] & 2), "num_pages": pages}
        return end

    def segment(self, start: int) -> int | None:
        d = self.data
        if len(d) - start < 6:
            self.say(start, "a segment header is cut off")
            return None
        number, flags, count = struct.unpack_from(">IBB", d, start)
        stype = flags & 63 if flags & 63 in TYPES else None
        at = start + 6
        form, n, retain = "Short", count >> 5, [bool(count >> i & 1) for i in range((count >> 5) + 1)]
        if n == 7:
            form = "Long"
            if len(d) - at < 3:
                self.say(at, "a long count of referred-to segments is cut off", number, stype)
                return None
            n = int.from_bytes(d[at - 1 : at + 3], "big") & 0x1FFFFFFF
            at += 3
            size = n // 8 + 1
            if len(d) - at < size:
                self.say(at, "the retain bits of a long count are cut off", number, stype)
                return None
            bits = d[at : at + size]
            retain = [bool(bits[i >> 3] >> (i & 7) & 1) for i in range(n + 1)]
            at += size
        elif n > 4:
            self.say(at - 1, "reserved form of the count of referred-to segments", number, stype)
            form, n, retain = "Reserved", 0, []
        width = 1 if number < 256 else 2 if number < 65536 else 4
        if len(d) - at < n * width:
            self.say(at, "the referred-to segment numbers are cut off", number, stype)
            return None
        referred = [int.from_bytes(d[at + i * width : at + (i + 1) * width], "big") for i in range(n)]
        at += n * width
        wide = 4 if flags & 64 else 1
        if len(d) - at < wide + 4:
            self.say(at, "page association or data length is cut off", number, stype)
            return None
        page, length = _be(d, at, wide), _be(d, at + wide, 4)
        at += wide + 4
        end = len(d)
        if length != UNKNOWN_LENGTH:
            end = at + length
            if end > len(d):
                self.say(at, "the data length goes beyond the stream", number, stype)
                end = len(d)
        body = d[at:end]
        row = {"ord": len(self.segments), "off": start, "hl": at - start, "number": number, "flags": flags, "stype": stype, "form": form, "deferred": bool(flags & 128), "page32": bool(flags & 64)}
        row |= {"referred": referred, "retain": retain, "page": page, "data_length": None if length == UNKNOWN_LENGTH else length, "body": body}
        self.segments.append(row | dict.fromkeys(_BODY_NAMES) | body_of(stype, body))
        return end


def open_streams(spark: SparkSession, path: str) -> DataFrame:
    """(sid, content) of the files at ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("sid"), "content")


def parse_streams(streams: DataFrame, key: str = "sid", content: str = "content") -> DataFrame:
    """(sid, input_len, header, segments, diagnostics): a row per stream."""
    kind = streams.schema[key].dataType
    schema = StructType().add("sid", kind)
    for f in _parse_datatype_string(f"input_len bigint, header struct<{_typed(HEADER)}>, segments array<struct<{_typed(SEGMENT)}>>, diagnostics array<struct<{_typed(DIAGNOSTIC)}>>"):
        schema.add(f)
    arrow = to_arrow_schema(schema)

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 64):  # bounds the batches that go back
                part = b.slice(lo, 64)
                rows = [None if x is None else Parser(x) for x in part.column(1).to_pylist()]
                cols = [part.column(0), [None if p is None else len(p.data) for p in rows], *([None if p is None else getattr(p, f) for p in rows] for f in ("header", "segments", "said"))]
                yield pa.RecordBatch.from_arrays([cols[0].cast(arrow.types[0]), *(pa.array(c, t) for c, t in zip(cols[1:], arrow.types[1:]))], arrow.names)

    return streams.select(key, content).mapInArrow(parse, schema)


def _typed(fields: str) -> str:
    return ", ".join(x.replace(" ", ":", 1) for x in fields.split(", "))


def segments(parsed: DataFrame) -> DataFrame:
    """A row per segment, with the stream's key."""
    return parsed.select("sid", F.explode("segments").alias("s")).select("sid", "s.*")


def diagnostics(parsed: DataFrame) -> DataFrame:
    return parsed.select("sid", F.explode("diagnostics").alias("s")).select("sid", "s.*")


def type_name(stype: Column) -> Column:
    """The segment type's name; Unknown for reserved ones."""
    names = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(names[stype], F.lit("Unknown"))


def listing(parsed: DataFrame) -> DataFrame:
    """The segment tree: a line per segment, in order."""
    s = segments(parsed)
    return s.select("sid", "ord", "number", type_name(F.col("stype")).alias("type"), "page", "referred", F.col("off"), F.length("body").alias("body_len"))


def strict_errors(parsed: DataFrame) -> DataFrame:
    """(sid, off, message) of the first thing that a strict reader refuses: what the
    tolerant parser remarked, an unknown segment type, or a random-access file."""
    said = F.transform("diagnostics", lambda d: F.struct(d.off.alias("off"), d.message.alias("message")))
    unknown = F.transform(F.filter("segments", lambda s: s.stype.isNull()), lambda s: F.struct((s.off + 4).alias("off"), F.lit("unknown segment type").alias("message")))
    order = F.when(F.col("header.sequential") == F.lit(False), F.array(F.struct(F.lit(8).cast("bigint").alias("off"), F.lit("random-access organisation").alias("message")))).otherwise(F.expr("cast(array() as array<struct<off:bigint,message:string>>)"))
    first = F.array_min(F.concat(said, unknown, order))
    return parsed.select("sid", first.alias("e")).where("e is not null").select("sid", "e.*")


# ---- writing -------------------------------------------------------------------------


def file_header(num_pages: int | None, sequential: bool = True) -> bytes:
    flags = int(sequential) | (2 if num_pages is None else 0)
    return MAGIC + bytes([flags]) + (b"" if num_pages is None else struct.pack(">I", num_pages))


def segment_bytes(number: int, stype: int, body: bytes, page: int = 0, referred: list[int] = (), retain: list[bool] | None = None, deferred: bool = False, unknown_length: bool = False) -> bytes:
    """A canonical header and the body: the short form for up to four references, a
    one-byte page where it fits."""
    n = len(referred)
    retain = list(retain) if retain is not None else [True] * (n + 1)
    if len(retain) != n + 1:
        raise ValueError("a retain bit for each referred-to segment and one for the segment itself")
    out = struct.pack(">IB", number, stype | (64 if page > 255 else 0) | (128 if deferred else 0))
    bits = sum(int(b) << i for i, b in enumerate(retain))
    out += bytes([n << 5 | bits]) if n <= 4 else struct.pack(">I", 7 << 29 | n) + bits.to_bytes(n // 8 + 1, "little")
    width = 1 if number < 256 else 2 if number < 65536 else 4
    out += b"".join(r.to_bytes(width, "big") for r in referred)
    out += struct.pack(">I" if page > 255 else ">B", page)
    return out + struct.pack(">I", UNKNOWN_LENGTH if unknown_length else len(body)) + body


def region_bytes(width: int, height: int, x: int = 0, y: int = 0, flags: int = 0) -> bytes:
    return struct.pack(">4IB", width, height, x, y, flags)


def page_bytes(width: int, height: int, flags: int = 0, stripe: int = 0, resolution: tuple[int, int] = (0, 0)) -> bytes:
    return struct.pack(">4IBH", width, height, *resolution, flags, stripe)


def end_of_page_bytes() -> bytes:
    return b""


def end_of_stripe_bytes(y: int) -> bytes:
    return struct.pack(">I", y)


def emit_streams(rows: DataFrame, num_pages: str | None = None) -> DataFrame:
    """(sid, content) of segment rows (sid, ord, number, stype, page, referred, body);
    ``num_pages`` is an expression over a stream's rows, None leaves it unknown."""
    kind = rows.schema["sid"].dataType
    schema = StructType().add("sid", kind).add("ord", LongType()).add("data", BinaryType())

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data = [segment_bytes(n, t, body or b"", p, r or []) for n, t, p, r, body in zip(*(b.column(k).to_pylist() for k in range(2, 7)))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(to_arrow_type(kind)), b.column(1), pa.array(data, pa.binary())], ["sid", "ord", "data"])

    counts = rows.groupBy("sid").agg((F.expr(num_pages) if num_pages else F.lit(None)).cast("bigint").alias("pages"))
    made = rows.select("sid", F.col("ord").cast("bigint"), "number", "stype", "page", "referred", "body").mapInArrow(emit, schema)
    # a stream is bounded by what one file can hold
    joined = made.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("ord", F.hex("data").alias("h")))).alias("s")).join(counts, "sid")
    head = F.when(F.col("pages").isNull(), F.lit(file_header(None).hex())).otherwise(F.concat(F.lit(file_header(0).hex()[:18]), F.lpad(F.hex("pages"), 8, "0")))
    return joined.select("sid", F.unhex(F.concat(head, F.array_join("s.h", ""))).alias("content"))
