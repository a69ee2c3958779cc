"""Matrices, catalogues, anchors, outcomes, fixtures and image files."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import conformance as cf
from bitloom.sources import images

ISSUE = "phase string, row string, column string, upstream string, evidence string, wontfix boolean, vendor_kind string, vendor_path string, vendor_expected string, expect_kind string, expect_text string"


@pytest.fixture(scope="module")
def tables(spark):
    axes = spark.createDataFrame([("decode", r, k) for r in ("us", "them") for k in ("v1", "v2", "v3")], "phase string, row string, column string")
    issues = spark.createDataFrame(
        [
            ("decode", "them", "*", "bug 1", "seen", False, "git", "vendor/t", "abc", "contains", "boom"),
            ("decode", "them", "v2", "bug 2", "https://x.org/2", True, "git", "vendor/t", "abc", "any", None),
            ("decode", "us", "v1", "bug 3", "seen", False, None, None, None, "any", None),
        ],
        ISSUE,
    )
    return axes, issues


def test_classification(spark, tables):
    axes, issues = tables
    cells = [("us", "v1", "ok", ""), ("us", "v2", "error", "x"), ("us", "v3", "lossy", ""), ("them", "v1", "break", "boom!"), ("them", "v2", "break", "z"), ("them", "v3", "break", "other"), ("none", "v1", "break", ""), ("none", "v2", "skip", ""), ("none", "v3", "blank", "")]
    df = spark.createDataFrame([("decode", *r) for r in cells], "phase string, row string, column string, kind string, text string")
    got = cf.classify(df, issues, axes)
    assert {(r.row, r.column): r.token for r in got.collect()} == {("us", "v1"): "OK*", ("us", "v2"): "ERR", ("us", "v3"): "OK", ("them", "v1"): "KI", ("them", "v2"): "WTF", ("them", "v3"): "ERR!", ("none", "v1"): "BRKN", ("none", "v2"): "SKIP", ("none", "v3"): ""}
    (s,) = cf.matrix_stats(got).collect()
    assert s.strict_failed and all(s[n] == 1 for n in cf.TOKENS)
    assert not cf.matrix_stats(got.where("token in ('KI', 'OK', 'BRKN')")).first().strict_failed


def test_issue_catalogue(spark, tables):
    axes, issues = tables
    assert cf.issue_errors(issues, axes).count() == 0
    bad = spark.createDataFrame([("decode", "*", "v9", " ", "", True, None, None, None, None, None), ("decode", "who", "v1", "u", "see vendor/x", False, None, None, None, None, None)], ISSUE)
    got = {(r.row, r.error) for r in cf.issue_errors(bad, axes).collect()}
    assert got == {("*", "no upstream"), ("*", "no evidence"), ("*", "a wildcard for rows"), ("*", "won't be fixed, without an address that says so"), ("*", "unknown column"), ("who", "evidence in vendor/ without a pin"), ("who", "unknown row")}


def test_anchors(spark, tables):
    pins = cf.anchors(tables[1])
    assert [tuple(r) for r in pins.collect()] == [("git", "vendor/t", "abc", False)]
    other = tables[1].limit(1).withColumn("vendor_expected", F.lit("def"))
    assert cf.anchors(tables[1].unionByName(other)).first().conflict
    files = spark.createDataFrame([("vendor/t/bin/x",), ("vendor/tt/x",), ("vendor/t",)], "binary string")
    assert {r.binary: r.expected for r in cf.anchor_of(files, pins).collect()} == {"vendor/t/bin/x": "abc", "vendor/tt/x": None, "vendor/t": "abc"}
    seeds = spark.createDataFrame([("a", "p", hashlib.sha256(b"1").hexdigest().upper()), ("b", "p", "00")], "relative string, path string, sha256 string")
    assert [r.relative for r in cf.drift(seeds, spark.createDataFrame([("p", b"1")], "path string, content binary")).collect()] == ["b"]


def test_outcomes(spark):
    rows = [("f1", "a", None, "", None, 0, None), ("f2", "a", "timeout", "", None, None, None), ("f3", "a", "memory", "", None, None, None), ("f4", "a", "output", "", None, None, None), ("f5", "a", None, "x AddressSanitizer: y", 6, None, None), ("f6", "a", None, None, 11, None, None), ("f7", "a", None, "no", None, 3, None), ("f8", "a", None, "", None, None, "gone")]
    out = spark.createDataFrame(rows, "fixture string, impl string, kill_reason string, stderr string, signal int, code int, spawn_error string")
    got = {r.fixture: (r.token, r.classification, r.verdict) for r in cf.outcome_token(out).collect()}
    assert got == {"f1": ("OK", "OK", "Ok"), "f2": ("TIMEOUT", "TIMEOUT", "Timeout"), "f3": ("OOM", "SAN", "Crash"), "f4": ("OUTCAP", "EXIT", "RejectErr"), "f5": ("SAN(ASAN)", "SAN", "Crash"), "f6": ("SIG=11", "CRASH", "Crash"), "f7": ("EXIT 3", "EXIT", "RejectErr"), "f8": ("SPAWN", "SPAWN", "Unknown")}
    want = spark.createDataFrame([("f1", "a", "Ok"), ("f2", "a", "Ok"), ("f3", "a", "Unknown"), ("f9", "a", "Ok"), ("f1", "b", "Ok")], "fixture string, impl string, verdict string")
    assert {tuple(r) for r in cf.expectation_mismatches(want, out).collect()} == {("f2", "a", "Ok", "Timeout"), ("f9", "a", "Ok", "Unknown")}
    v = spark.createDataFrame([(0, True, True, 0, 9, None), (1, True, True, 0, 9, None), (0, True, True, 1, 9, None), (0, True, True, 1, 100, 0.01), (0, True, True, 2, 100, 0.01), (0, True, False, 0, 1, 0.1)], "e int, d boolean, s boolean, n int, t int, c double")
    assert [r[0] for r in v.select(cf.encode_verdict(*map(F.col, "edsntc"))).collect()] == ["ok", "fail", "fail", "lossy", "fail", "fail"]


def test_fixture_folders(spark, tmp_path):
    for name, stream in (("b/two", None), ("a/one", b"abc")):
        d = tmp_path / name
        d.mkdir(parents=True)
        (d / "expected.toml").write_text(cf.write_expected("T88-7.2.3-001", ['x"y', "z"]) + '[decoder.x]\nverdict = "Ok"\n')
        if stream:
            (d / "stream.jb2").write_bytes(stream)
    got = cf.fixtures(spark, str(tmp_path)).collect()
    assert [(r.relative, r.primary_check_id, r.check_ids, [tuple(e) for e in r.expectations], r.stream) for r in got] == [("a/one", "T88-7.2.3-001", ['x"y', "z"], [("x", "Ok")], b"abc"), ("b/two", "T88-7.2.3-001", ['x"y', "z"], [("x", "Ok")], None)]


def test_image_files(spark):
    b = (np.random.default_rng(0).random((5, 11)) < 0.5).astype(np.uint8)
    pbm = images.write_pbm(b)
    assert all((x == b).all() for x in images.read_pbm(pbm + b"P4\n# note\n11 5\n" + pbm.split(b"\n", 2)[2]))

    def bmp(depth, raw, palette=b"", up=True):
        start = 54 + len(palette)
        return b"BM" + struct.pack("<IHHIIiiHHIIiiII", start + len(raw), 0, 0, start, 40, 11, 5 if up else -5, 1, depth, 0, len(raw), 0, 0, 0, 0) + palette + raw

    one = b"".join(np.packbits(r).tobytes().ljust(4, b"\0") for r in b[::-1])
    white_first = bmp(1, one, b"\xff\xff\xff\0\0\0\0\0")
    colour = b"".join((np.repeat(255 - 255 * r, 3).astype(np.uint8).tobytes()).ljust(36, b"\0") for r in b)
    assert (images.read_bmp(white_first) == b).all() and (images.read_bmp(bmp(24, colour, up=False)) == b).all()
    assert (images.read_bmp(bmp(1, one, b"\0\0\0\0\xff\xff\xff\0")) == 1 - b).all()
    assert images.one_bit(white_first) and not images.one_bit(bmp(24, colour))
    rows = images.read_pages(spark.createDataFrame([("p", pbm), ("m", white_first), ("x", b"P5 1 1"), ("n", None)], "path string, content binary")).collect()
    assert {r.sid: (r.page, r.width, r.height, r.error is None) for r in rows} == {"p": (1, 11, 5, True), "m": (1, 11, 5, True), "x": (None, None, None, False)}
