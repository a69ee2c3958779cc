"""Codes of whole columns against those of one value at a time."""

import numpy as np
import pytest

from bitloom.functions import huffman


def single(k, v):
    w = huffman.Writer()
    huffman.standard(k).encode(w, v)
    return w.finish()


@pytest.mark.parametrize("k", range(1, 16))
def test_columns_are_the_tables_own_streams(k):
    rng = np.random.default_rng(k)
    values = []
    for x in [*range(-2100, 2100), *rng.integers(-(1 << 31), 1 << 31, 300).tolist()]:
        try:
            single(k, x)
            values.append(x)
        except ValueError:
            with pytest.raises(ValueError):
                huffman.standard(k).columns.encode(np.array([x]))
    v = np.array(values)
    data, ends = huffman.standard(k).columns.encode(v)
    assert data.tobytes() == b"".join(single(k, x) for x in values)
    back, oob = huffman.standard(k).columns.decode(data, ends)
    assert np.array_equal(back, v) and not oob.any()


def test_columns_know_damage_and_out_of_band():
    w = huffman.Writer()
    huffman.standard(2).encode(w, None)
    data = np.frombuffer(w.finish(), np.uint8)
    assert huffman.standard(2).columns.decode(data, np.array([len(data)]))[1].tolist() == [True]
    data, ends = huffman.standard(1).columns.encode(np.array([70000, 3]))
    with pytest.raises(ValueError, match="ends early"):
        huffman.standard(1).columns.decode(data[:4], np.array([4]))
    assert huffman.standard(1).columns.decode(*huffman.standard(1).columns.encode(np.zeros(0, np.int64)))[0].tolist() == []


def test_round_trip_keeps_null_keys(spark, tmp_path):
    from bitloom.operators import codecs

    spark.sql("select * from values (1L, 7L), (null, 8L), (3L, null) t(o_orderkey, o_custkey)").write.parquet(f"{tmp_path}/orders.parquet")
    rows = codecs.huffman_roundtrip(spark, str(tmp_path)).collect()
    assert len(rows) == 45 and sum(r.decoded is None for r in rows) == 30
    assert {(r.table_no, r.decoded) for r in rows if r.o_orderkey == 1} == {(k, 1 if k == 14 else 8) for k in range(1, 16)}
