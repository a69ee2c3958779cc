"""Parsing, checking and writing of real bytes."""

import struct

import pytest

from bitloom.operators import validation
from bitloom.sources import streams as st

u16, u32 = (lambda v: struct.pack(">H", v)), (lambda v: struct.pack(">I", v))
HEAD = st.MAGIC + b"\x03"


def seg(number, flags, count, referred, page, body):
    return u32(number) + bytes([flags, count, *referred, page]) + u32(len(body)) + body


def eof(n):
    return seg(n, 51, 0, [], 0, b"")


REGION = st.region_bytes
SYMBOLS = u16(0) + bytes(8) + u32(1) + u32(1) + b"\xff"
REFAGG = u16(2) + u32(1) + u32(1)
MINTED = {
    "7.2.3-001": seg(1, 0x33, 0xA0, [], 0, b""),
    "7.4.1-001": seg(1, 0x26, 0, [], 1, REGION(0, 1) + b"\0") + eof(2),
    "7.4.2-001": seg(1, 0, 0, [], 0, u16(0xE000) + u32(1) + u32(1)) + eof(2),
    "7.4.2-009": seg(1, 0, 0x21, [2], 0, REFAGG) + seg(2, 0, 0, [], 0, REFAGG) + eof(3),
    "7.4.3-002": seg(1, 0, 0, [], 0, SYMBOLS) + seg(2, 7, 0x21, [1], 1, REGION(1, 1) + u16(0) + u32(0)) + eof(3),
    "7.4.4-001": seg(1, 16, 0, [], 0, bytes([0, 0, 1]) + u32(0)) + eof(2),
    "7.4.6-001": seg(1, 0x26, 0, [], 1, REGION(1, 1) + bytes([14, 0, 0, 255])) + eof(2),
    "7.4.7-001": seg(1, 0x2A, 0, [], 1, REGION(1, 1) + bytes([0xFC, 0, 0, 0, 0, 255])) + eof(2),
    "7.4.12-001": seg(1, 0x34, 0, [], 0, b"") + eof(2),
    "7.4.13-001": seg(1, 0x35, 0, [], 0, b"") + eof(2),
}
#: Everything that should be said about each of them.
ALL = {
    "7.2.3-001": {"PARSE-001", "7.2.3-001", "7.2.4-001"},
    "7.4.1-001": {"7.3.2-001", "7.4.1-001", "6.2.5.3-001"},
    "7.4.2-001": {"7.4.2-001"},
    "7.4.2-009": {"7.3.1-002", "7.4.2-009"},
    "7.4.3-002": {"7.3.2-001", "7.4.3-002"},
    "7.4.4-001": {"7.4.4-001"},
    "7.4.6-001": {"7.3.2-001", "7.4.6-001"},
    "7.4.7-001": {"7.3.2-001", "7.4.7-001", "7.4.7-002"},
    "7.4.12-001": {"7.4.12-001"},
    "7.4.13-001": {"7.4.13-001"},
}
OTHERS = {
    "clean": (HEAD + eof(1), set()),
    "short": (b"\x97JB", {"PARSE-001"}),
    "no magic": (eof(1) + b"", {"PARSE-001"}),
    "no flags": (st.MAGIC, {"PARSE-001"}),
    "cut page count": (st.MAGIC + b"\x01\0", {"PARSE-001"}),
    "reserved header flags": (st.MAGIC + b"\x81" + u32(1) + eof(1), {"D.4-001"}),
    "no pages": (st.MAGIC + b"\x01" + u32(0) + eof(1), {"D.4-002"}),
    "cut header": (HEAD + b"\0\0\0", {"PARSE-001"}),
    "cut refs": (HEAD + u32(1) + b"\x33\x40\x01", {"PARSE-001"}),
    "cut length": (HEAD + u32(1) + b"\x33\x00\x01\0", {"PARSE-001"}),
    "long form cut": (HEAD + u32(1) + b"\x33\xe0\0", {"PARSE-001"}),
    "body beyond": (HEAD + u32(1) + b"\x34\0\0" + u32(8) + bytes(4), {"PARSE-001", "7.2.7-001"}),
    "unknown type": (HEAD + seg(1, 0x3F, 0, [], 0, b"") + eof(2), {"7.2.2-001"}),
    "unknown length": (HEAD + u32(1) + b"\x30\0\x01" + b"\xff" * 4 + st.page_bytes(1, 1), {"7.2.7-002", "7.4.9-001"}),
    "order": (HEAD + seg(2, 0x3E, 0, [], 0, bytes(4)) + seg(2, 0x3E, 0, [], 0, bytes(3)) + eof(3), {"7.2.1-001", "7.4.15-001"}),
    "dangling": (HEAD + seg(1, 0x33, 0x20, [9], 0, b""), {"7.3.1-001", "7.3.1-002"}),
    "page": (HEAD + seg(1, 0x30, 0, [], 1, st.page_bytes(0, 3)) + seg(2, 0x31, 0, [], 1, b"") + eof(3), {"7.4.8-001"}),
    "huffman text": (HEAD + seg(1, 0, 0, [], 0, SYMBOLS) + seg(2, 0x30, 0, [], 1, st.page_bytes(1, 1)) + seg(3, 6, 0x21, [1], 1, REGION(1, 1) + u16(1) + u16(0x8000) + u32(1)) + seg(4, 0x31, 0, [], 1, b"") + eof(5), {"7.4.3-001"}),
    "implausible": (HEAD + seg(1, 0, 0, [], 0, u16(1) + u32(1_000_001) + u32(1)) + eof(2), {"A-001"}),
    "palette, halftone": (HEAD + seg(1, 54, 0, [], 0, b"abc") + seg(2, 22, 0, [], 0, REGION(1, 1) + bytes([0x50]) + u32(1) + u32(1)) + eof(3), {"7.4.14-001", "7.4.5-001"}),
    "null": (None, set()),
}


@pytest.fixture(scope="module")
def bytes_of(spark):
    rows = [(k, HEAD + v) for k, v in MINTED.items()] + [(k, v) for k, (v, _) in OTHERS.items()]
    return spark.createDataFrame(rows, "sid string, content binary")


def test_findings_of_real_streams(bytes_of):
    got: dict = {}
    for r in validation.validate(bytes_of).collect():
        got.setdefault(r.sid, set()).add(r.check_id.removeprefix("T88-"))
    want = ALL | {k: v for k, (_, v) in OTHERS.items()}
    # the header of a stream without ID string is still read as a segment
    assert {k: got.get(k, set()) for k in want} == want
    assert all(k in got[k] for k in MINTED)


def test_lenses_and_reports(bytes_of):
    soft = validation.validate(bytes_of, "itu").where("check_id = 'T88-7.4.2-009'").collect()
    assert {r.severity for r in soft} == {"Warning"}
    assert {r.severity for r in validation.validate(bytes_of, "imageio").where("check_id = 'T88-7.4.14-001'").collect()} == {"Warning"}
    assert {r.severity for r in validation.validate(bytes_of, "jbig2dec").where("check_id = 'T88-7.4.14-001'").collect()} == {"Warning"}
    cells = {r.sid: r for r in validation.report(validation.validate(bytes_of), bytes_of, ids=2).collect()}
    assert cells["clean"].cell == "OK" and cells["clean"].ok and cells["clean"].highest is None
    assert cells["7.2.3-001"].cell == "BAD(3):T88-7.2.3-001,T88-7.2.4-001"
    assert cells["null"].errors == 0


def test_offsets_and_names(bytes_of):
    got = {(r.sid, r.check_id): r for r in validation.validate(bytes_of).collect()}
    r = got["7.4.6-001", "T88-7.4.6-001"]
    assert (r.byte_offset, r.segment_number, r.segment_type, r.ord) == (9 + 11 + 17, 1, "ImmediateGenericRegion", 0)
    r = got["cut refs", "T88-PARSE-001"]
    assert (r.byte_offset, r.segment_number, r.segment_type) == (15, 1, "EndOfFile")
    assert got["short", "T88-PARSE-001"].segment_type is None
    assert got["unknown type", "T88-7.2.2-001"].segment_type == "Unknown"


def test_strict_reader(bytes_of):
    bad = {r.sid: (r.off, r.message) for r in st.strict_errors(st.parse_streams(bytes_of)).collect()}
    assert "clean" not in bad and "null" not in bad and "7.4.3-002" not in bad
    assert bad["unknown type"] == (13, "unknown segment type") and bad["short"][0] == 0


@pytest.mark.parametrize("number, refs, page", [(1, [], 0), (9, [1, 2, 3, 4], 255), (300, [1, 2, 3, 4, 299], 256), (70_000, list(range(20)), 70_000)])
def test_segment_bytes_round_trip(number, refs, page):
    retain = [k % 3 == 0 for k in range(len(refs) + 1)]
    data = st.file_header(7) + st.segment_bytes(number, 62, b"abcd", page, refs, retain, deferred=True) + st.segment_bytes(number + 1, 38, b"xyz", 1, unknown_length=True)
    p = st.Parser(data)
    assert not p.said and p.header == {"flags": 1, "sequential": True, "unknown_pages": False, "num_pages": 7, "first_segment": 13}
    a, b = p.segments
    assert (a["number"], a["referred"], a["page"], a["retain"], a["deferred"], a["body"]) == (number, refs, page, retain, True, b"abcd")
    assert b["data_length"] is None and b["body"] == b"xyz" and a["form"] == ("Short" if len(refs) < 5 else "Long")


def test_emitted_streams_parse_back(spark, tmp_path):
    rows = [("a", 1, 2, 62, 1, [1], b"more"), ("a", 0, 1, 48, 1, [], st.page_bytes(5, 6)), ("a", 2, 3, 51, 0, [], b""), ("b", 0, 4, 51, 0, None, None)]
    df = spark.createDataFrame(rows, "sid string, ord bigint, number bigint, stype int, page bigint, referred array<bigint>, body binary")
    out = st.emit_streams(df, "max(page)")
    got = sorted((r.sid, r.ord, r.number, r.stype, r.page, r.referred, bytes(r.body)) for r in st.segments(st.parse_streams(out)).collect())
    assert got == sorted((s, o, n, t, p, list(r or []), b or b"") for s, o, n, t, p, r, b in rows)
    assert {r.sid: r.n for r in st.parse_streams(out).select("sid", "header.num_pages").toDF("sid", "n").collect()} == {"a": 1, "b": 0}
    for r in out.collect():
        (tmp_path / f"{r.sid}.bin").write_bytes(r.content)
    assert st.parse_streams(st.open_streams(spark, str(tmp_path))).count() == 2
    assert [r.type for r in st.listing(st.parse_streams(out)).where("sid = 'a'").orderBy("ord").collect()] == ["PageInformation", "Extension", "EndOfFile"]
