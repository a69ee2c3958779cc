"""What a task holds at a time and leaves behind in its worker."""

import pyarrow as pa
import pytest

from bitloom.llm import packing, quality, simhash, suffix, textops, toxicity
from bitloom.llm.textops import text_key


def documents(n):
    texts = [" ".join(f"d{k}w{i}" for i in range(60)) for k in range(n)]
    return texts, pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts)], ["doc_id", "text"])


def test_runs_come_in_batches_of_bounded_size(monkeypatch):
    monkeypatch.setattr(suffix, "_BATCH_BYTES", 20_000, raising=False)
    monkeypatch.setattr(suffix, "_BATCH_SPANS", 50, raising=False)
    texts, docs = documents(300)
    anchors = [[{"key": text_key(t.encode()), "place": 0}] for t in texts]
    batch = pa.RecordBatch.from_arrays([*docs.columns, pa.array(anchors)], ["doc_id", "text", "anchors"])
    copies = pa.RecordBatch.from_arrays([pa.array(range(1000, 1300), pa.int64()), *batch.columns[1:]], batch.schema.names)
    out = list(suffix._run_batches(suffix.SuffixRules(), [], 64)(iter([batch, copies])))
    assert max(b.nbytes for b in out) < 30_000
    rows = pa.Table.from_batches(out)
    runs = [x for x in rows.column("run").to_pylist() if x is not None]
    assert sum(1 for x in runs for _ in suffix.front_decode(x)) == 300  # every suffix once
    assert len({r for r in rows.column("range").to_pylist() if r is not None}) == len(runs)
    spans = {(r["doc_id"], r["ref_doc"]) for r in rows.to_pylist() if r["range"] is None}
    assert spans == {(1000 + k, k) for k in range(300)}


@pytest.mark.parametrize("f", [simhash._fingerprint_batches, suffix._anchor_batches(suffix.SuffixRules()), quality._histogram_batches(1, [0], "q")])
def test_a_task_leaves_no_free_memory_in_its_worker(monkeypatch, f):
    seen = []
    monkeypatch.setattr(textops, "release", lambda: seen.append(1))
    assert sum(b.num_rows for b in f(iter([documents(5)[1]]))) >= 5
    assert seen == [1]
    assert packing.releasing is toxicity.releasing is textops.releasing
