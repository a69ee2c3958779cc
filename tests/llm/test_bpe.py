"""Words that are hard to tell apart, long words, decoding, and messy rows."""

from collections import Counter

import pytest
import tiktoken

from bitloom.llm import bpe, tokens
from bitloom.llm.pretokens import Merger, merge_word


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.vocabulary(tokens.VOCABULARY), special_tokens={})


def thue_morse(a, b, order=11):
    s = "a"
    for _ in range(order):
        s += s.translate(str.maketrans("ab", "ba"))
    return s.translate(str.maketrans("ab", a + b))


def test_words_that_collide_under_polynomial_hashes(spark, encoder):
    docs = spark.createDataFrame([(1, thue_morse("t", "h")), (2, thue_morse("h", "t"))], "doc_id bigint, text string")
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()}
    got = bpe.encode_documents(docs)
    rows = {r.doc_id: r for r in got.collect()}
    for i, text in ((1, thue_morse("t", "h")), (2, thue_morse("h", "t"))):
        want = encoder.encode_ordinary(text)
        assert counts[i] == len(want) and rows[i].ids == want and rows[i].round_trip
    assert counts == {1: 1195, 2: 1194}
    assert {r.doc_id: r.text for r in bpe.decode_documents(got).collect()} == {1: thue_morse("t", "h"), 2: thue_morse("h", "t")}


def test_a_word_of_more_than_65535_ids(spark, encoder):
    text = "before " + "qz" * 70_000 + " after"
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    encoded = bpe.encode_documents(docs)
    got = {r.doc_id: r for r in encoded.collect()}
    assert got[1].ids == encoder.encode_ordinary(text) and got[1].n_tokens == len(got[1].ids) > 65_535
    assert got[1].round_trip and got[2].round_trip
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded).collect()} == {1: text, 2: "short"}


@pytest.mark.parametrize("chunk", [1, 40, bpe.CHUNK_CHARS])
def test_messy_rows_in_chunks_of_any_size(spark, encoder, chunk):
    texts = [None, "", " ", "one two", "one two", "a\0b \0", "ö é 漢字 🎉 it's", "x" * 3000, "\n\n  tail  ", "don't we'll 123 !!"]
    rows = [(f"id{min(k, 4)}", t, "w", 1, 2, b"x", 3) for k, t in enumerate(texts)] + [(None, "no id", "w", 1, 2, b"x", 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, word string, number int, chunk bigint, codes binary, length bigint")
    encoded = bpe.encode_documents(docs, chunk_chars=chunk)
    want = Counter((r[0], None if r[1] is None else tuple(encoder.encode_ordinary(r[1])), None if r[1] is None else True) for r in rows)
    assert Counter((r.doc_id, None if r.ids is None else tuple(r.ids), r.round_trip) for r in encoded.collect()) == want
    assert Counter((r.doc_id, r.text) for r in bpe.decode_documents(encoded, chunk_ids=chunk).collect()) == Counter(r[:2] for r in rows)
    counts = Counter((r.doc_id, r.n_tokens) for r in tokens.count_tokens(docs).collect())
    assert counts == Counter((r[0], len(encoder.encode_ordinary(r[1] or ""))) for r in rows)
    assert bpe.encode_documents(docs.limit(0)).count() == bpe.decode_documents(encoded.limit(0)).count() == 0


def test_decoding_unknown_ids(spark):
    df = spark.createDataFrame([(1, [10**6]), (2, [None, 1]), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_documents(df).collect()} == {1: None, 2: None, 3: ""}


def test_merging_many_words_at_once():
    import random

    import pyarrow as pa

    r = random.Random(5)
    ranks = tokens.vocabulary(tokens.VOCABULARY)
    words = [bytes(r.choice(b"abehtinos '\xc3\xa9\xff") for _ in range(r.randrange(0, 90))) for _ in range(3000)]
    ids, ends = Merger(ranks).merge(pa.array(words, pa.binary()))
    start = 0
    for word, end in zip(words, ends.tolist()):
        assert ids[start:end].tolist() == merge_word(word, ranks)
        start = end


def test_front_coded_words():
    import numpy as np
    import pyarrow as pa

    words = sorted({b"", b"a", b"ab", b"abc\0", b"abd", b"x" * 40 + b"1", b"x" * 40 + b"2", "ö".encode()} | {bytes([97 + k % 3] * (k % 37)) + bytes([k]) for k in range(200)})
    assert bpe.unpack_words(*bpe.pack_words(pa.array(words, pa.binary()))).to_pylist() == words
    v = np.array([0, 127, 128, 16383, 16384, 1 << 21, (1 << 28) + 5])
    assert bpe.unpack_numbers(bpe.pack_numbers(v)[0]).tolist() == v.tolist()
