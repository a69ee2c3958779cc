"""Many ranges, small runs and groups of copies against the plain version."""

import plain
import pytest

from bitloom.llm import suffix
from bitloom.llm.textops import text_key
from bitloom.session import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rules", [suffix.SuffixRules(range_suffixes=20, sampling=1), suffix.SuffixRules(range_suffixes=20, sampling=2, coarse_ranges=3, run_bytes=2000), suffix.SuffixRules(range_suffixes=7, run_bytes=1)])
def test_spans_do_not_depend_on_ranges_and_runs(spark, rules):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    shared = " ".join(f"word{k}" for k in range(70))
    rows += [(1000 + k, f"{'lead ' * (k % 3)}{shared} tail{k % 4}") for k in range(60)] + [(1000, rows[0][1]), (1001, shared), (1001, shared)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got: dict = {}
    for r in suffix._spans(docs, rules).collect():
        got.setdefault((r.doc_id, r.key), set()).update(range(r.start_word, r.end_word))
        assert r.first_doc_id <= r.doc_id
    want = {k: v for k, v in plain.repeats(rows).items() if v}
    assert got == want
    assert all(text_key(" ".join(t.split()).encode()) for _, t in rows if t)
