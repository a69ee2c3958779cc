"""Sources of passages that a document holds more than once."""

import duckdb

from bitloom.llm import suffix


def test_own_repeats_have_the_corpus_source(spark):
    passage = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    a, b, c = passage("a"), passage("b"), passage("c", 55)
    rows = [
        (1, a),
        (2, f"x {a} y z {a} w"),
        (3, f"{b} q {c}"),
        (4, f"{c} r {b} s {a} t {c} u {b} v {a}"),
        (5, f"own {passage('d')} is {passage('d')}"),
        (6, " ".join(["p q"] * 90)),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted(con.execute(suffix.SQL["op5_suffix_dedup"]).fetchall())
    got = sorted((r.doc_id, r.start_word, r.end_word, r.n_words, r.first_doc_id) for r in suffix.repeated_passages(docs).collect())
    assert got == want
    assert [r[-1] for r in got if r[0] == 2] == [1, 1]
