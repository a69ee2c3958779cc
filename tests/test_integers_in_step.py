"""Integers of many streams in step against those of one stream at a time."""

import numpy as np
import pytest

from bitloom.functions import mq
from bitloom.operators import codecs


def single(values):
    enc, states = mq.Encoder(), bytearray(512)
    for x in [*values, None]:
        mq.encode_integer(enc, states, x)
    return enc.finish()


def flat(lists):
    return np.array([x for s in lists for x in s], np.int64), np.cumsum([len(s) for s in lists])


def test_the_streams_are_those_of_the_single_coder():
    rng = np.random.default_rng(5)
    lists = [[], [0], [-1], [3, 4, 19, 20, 83, 84, 339, 340, 4435, 4436, -4436, 1 << 32], [5] * 300]
    lists += [rng.integers(-(10**k), 10**k, n).tolist() for k in range(1, 10) for n in (1, 2, 7, 40)]
    values, ends = flat(lists)
    streams = mq.encode_integers(values, ends)
    assert streams == [single(s) for s in lists]
    back, stop = mq.decode_integers(streams)
    assert np.array_equal(back, values) and np.array_equal(stop, ends)


def test_nothing_and_damage():
    assert mq.encode_integers(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []
    assert len(mq.decode_integers([])[0]) == 0
    with pytest.raises(ValueError, match="ends early"):
        mq.decode_integers([single([7, 8]), b"\x00\x00"])


def test_orders_of_any_length_and_null_values(spark, tmp_path, monkeypatch):
    rows = [(1, k, float(k), 10.0 * k) for k in range(1, 150)] + [(2, 1, 5.0, 7.0), (2, 2, None, 7.0), (2, 3, 4.0, 9.4), (3, 2, None, 1.0)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {1: ",".join(str(-k if k % 2 == 0 else 10 * k) for k in range(1, 150)), 2: "7,9", 3: None}
    for limit in (0, 64, 1000):
        monkeypatch.setattr(codecs, "_IN_STEP", limit)
        assert {r.o_orderkey: r.decoded for r in codecs.integer_roundtrip(spark, str(tmp_path)).collect()} == want
