"""Mutants, their buckets, and bitmap functions."""

import numpy as np
import pytest

from bitloom.functions import bitmap as bm
from bitloom.operators import mutation
from bitloom.sources import streams as st


@pytest.fixture(scope="module")
def seeds(spark):
    a = st.file_header(1) + st.segment_bytes(0, 48, st.page_bytes(5, 6), 1) + st.segment_bytes(1, 49, b"", 1) + st.segment_bytes(2, 51, b"")
    return {"a": a, "b": b"\x00\xff\x7f"}, spark.createDataFrame([("a", a), ("b", b"\x00\xff\x7f"), ("n", None), ("e", b"")], "sid string, content binary")


def test_every_bit(seeds):
    want, df = seeds
    got = {(r.sid, r.case_id): r for r in mutation.bit_flip_sweep(df).collect()}
    assert len(got) == 8 * sum(map(len, want.values()))
    for (sid, case), r in got.items():
        data = bytearray(want[sid])
        data[case // 8] ^= 1 << case % 8
        assert r.content == bytes(data) and r.mutation == f"bit-flip byte={case // 8} bit={case % 8}"


def test_samples_change_one_byte_and_repeat(seeds):
    want, df = seeds
    for make in (mutation.sampled_bit_flips, mutation.sampled_byte_replacements):
        rows = make(df, 50).collect()
        assert len(rows) == 100 and sorted(map(tuple, rows)) == sorted(map(tuple, make(df.repartition(3), 50).collect()))
        for r in rows:
            assert len(r.content) == len(want[r.sid]) and sum(x != y for x, y in zip(r.content, want[r.sid])) == 1


def test_lengths_and_buckets(seeds):
    want, df = seeds
    parsed = st.parse_streams(df)
    rows = mutation.length_perturbations(df, parsed).where("sid = 'a'").collect()
    assert len(rows) == 6
    old = [s["data_length"] for s in st.Parser(want["a"]).segments]
    for r in rows:
        first = st.Parser(r.content).segments[r.case_id // 2]
        delta = int(r.mutation.split("delta=")[1])
        assert 1 <= abs(delta) <= 16 and (delta < 0) == bool(r.case_id % 2)
        assert (first["data_length"] or 0xFFFFFFFF) - old[r.case_id // 2] in (delta, delta + (1 << 32), 0xFFFFFFFF - old[r.case_id // 2])
    got = mutation.buckets(mutation.bit_flip_sweep(df.where("sid = 'a'")), keep=2).collect()
    assert len({(r.severity, r.check_id, r.segment_type) for r in got}) > 5
    assert all(r.k <= 2 and r.k <= r.total for r in got)


def test_bitmaps():
    b = bm.new(10, 3)
    bm.put(b, 9, 2, 1)
    bm.put(b, 10, 2, 1)
    assert bm.get(b, 9, 2) == 1 and bm.get(b, 10, 2) == bm.get(b, -1, 0) == 0 and b.sum() == 1
    assert (bm.from_packed(bm.to_packed(b), 10, 3) == b).all()
    with pytest.raises(ValueError):
        bm.from_packed(b"abc", 10, 3)
    assert bm.grow_height(b, 5, 1).sum() == 21 and bm.grow_height(b, 2).shape == (3, 10)
    assert bm.copy_rect(b, 8, 1, 4, 4).tolist() == [[0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
    assert bm.pixel_hash(b) != bm.pixel_hash(bm.new(10, 3)) != bm.pixel_hash(bm.new(3, 10))
    assert (bm.from_luma(bm.to_luma(b)) == b).all() and bm.differing(b, bm.new(10, 3)) == 1 and bm.differing(b, bm.new(3, 3)) is None
    page = np.zeros((3, 3, 3), np.uint8)
    bm.composite_colour(page, np.ones((2, 2), np.uint8), 2, -1, (255, 0, 9))
    assert page.sum() == 264 and bm.luma_of(page)[0, 2] == (299 * 255 + 114 * 9) // 1000
