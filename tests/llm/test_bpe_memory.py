"""What a task of ``bpe_decode`` holds at a time and leaves behind."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from bitloom.llm import bpe, textops
from bitloom.llm.tokens import VOCABULARY

TOKENS = pa.table({"id": pa.array([7, 300, 301, 9999], pa.int32()), "bytes": pa.array([b"\xe2\x82", b"\xac!", b" and", None], pa.binary())})


def test_ids_of_a_chunk_do_not_become_objects():
    n, docs = 2_000_000, 1000
    ids = pa.ListArray.from_arrays(pa.array(np.arange(docs + 1) * (n // docs), pa.int32()), pa.array(np.full(n, 301, np.int32)))
    t = pa.table({"doc_id": pa.array(range(docs), pa.int64()), "ids": ids})
    tracemalloc.start()
    out = bpe._decode_chunk(pa.int64())(t, TOKENS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["text"].to_pylist() == [" and" * (n // docs)] * docs
    assert peak < 48_000_000  # as objects, the ids alone take over 60 MB


@pytest.mark.parametrize("slice_ids", [1, 3, 1 << 18])
def test_slices_change_no_text(monkeypatch, slice_ids):
    monkeypatch.setattr(bpe, "_SLICE_IDS", slice_ids, raising=False)
    ids = [[7, 300], None, [], [301, None], [301, 9999], [7], [300, 301, 7, 300, 301], [301]]
    t = pa.table({"doc_id": pa.array(range(len(ids)), pa.int64()), "ids": pa.chunked_array([pa.array(ids[:3], pa.list_(pa.int32())), pa.array(ids[3:], pa.list_(pa.int32()))])})
    out = bpe._decode_chunk(pa.int64())(t, TOKENS)
    assert out["text"].to_pylist() == ["€!", None, "", None, None, "�", "�! and€! and", " and"]


def test_each_step_leaves_no_free_memory(monkeypatch):
    seen = []
    monkeypatch.setattr(textops, "release", lambda: seen.append(1))
    docs = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([[7, 300]], pa.list_(pa.int32()))], ["doc_id", "ids"])
    monkeypatch.setattr(bpe.TaskContext, "get", lambda: type("C", (), {"partitionId": lambda self: 0})())
    texts = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["a text"])], ["doc_id", "text"])
    exploded = pa.Table.from_batches(bpe._explode(100, 1)(iter([texts])))
    list(bpe._distinct_ids(100)(iter([docs])))
    words = exploded.filter(exploded["bucket"].is_valid())
    found = bpe._encode_bucket(VOCABULARY)(words)
    made = bpe._assemble(pa.int64(), VOCABULARY)(exploded.filter(exploded["bucket"].is_null()), found)
    assert made["round_trip"].to_pylist() == [True]
    bpe._decode_chunk(pa.int64())(pa.Table.from_batches([docs]), TOKENS)
    assert len(seen) == 5
