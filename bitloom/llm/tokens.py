"""Token counts with a whole-token shortcut.

Offline (``shortcut_words``), every vocabulary string that is itself one
pre-token is encoded by the merge rules; those that end as one token are proven
to count 1 wherever they occur as a pre-token, because pre-tokens are encoded
independently. Documents are then counted by looking up each distinct pre-token of
a slice of texts among the proven strings; only the rest is merged, each distinct
string once as long as a worker remembers it. Strings are compared as bytes, never
by a hash.

Defined results: null or empty text counts 0; texts and pre-tokens of any length
are counted whole (a pre-token of more than 64 bytes is merged with a heap);
repeated rows are counted once each; ``doc_id`` may be of any type; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from bitloom.llm.pretokens import Batch, Merger, merge_word, read_ranks
from bitloom.session import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(2)
def vocabulary(path: str) -> dict[bytes, int]:
    return read_ranks(path)


@lru_cache(2)
def shortcut_words(path: str) -> frozenset[bytes]:
    """The vocabulary strings that are one pre-token and encode as one token."""
    ranks = vocabulary(path)
    texts = []
    for word in ranks:
        try:
            texts.append(word.decode())
        except UnicodeDecodeError:
            continue
    b = Batch(texts)
    single = np.bincount(b.doc, minlength=len(texts)) == 1
    words = [t.encode() for t, one in zip(texts, single) if one]
    return frozenset(w for w in words if merge_word(w, ranks) == [ranks[w]])


def slices(texts: list[str | None], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters, to bound array sizes."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


#: Of each vocabulary, the counts of merged words that this worker has met; a
#: cache, emptied when it holds ``_REMEMBERED`` words and filled again.
_known: dict[str, dict[bytes, int]] = {}
_REMEMBERED = 1_000_000


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(vocabulary(path))


def token_counter(path: str):
    """A function from texts to (pre-tokens, counted whole, tokens) of each."""
    proven = pa.array(sorted(shortcut_words(path)), pa.binary())
    known = _known.setdefault(path, {})

    def merged(words: pa.Array) -> np.ndarray:
        out = list(map(known.get, words.to_pylist()))
        new = np.array([i for i, x in enumerate(out) if x is None], np.int64)
        if len(new):
            fresh = words.take(pa.array(new))
            sizes = np.diff(merger(path).merge(fresh)[1], prepend=0).tolist()
            if len(known) >= _REMEMBERED:
                known.clear()
            known.update(zip(fresh.to_pylist(), sizes))
            for i, k in zip(new.tolist(), sizes):
                out[i] = k
        return np.array(out, np.int64)

    def count(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pre, whole, total = (np.zeros(len(texts), np.int64) for _ in range(3))
        for lo, hi in slices(texts):
            x = Batch(texts[lo:hi])
            words = x.words()
            at = words.indices.to_numpy()
            hit = pc.is_in(words.dictionary, value_set=proven).to_numpy(zero_copy_only=False)
            n = np.ones(len(hit), np.int64)
            rest = np.flatnonzero(~hit)
            n[rest] = merged(words.dictionary.take(pa.array(rest)))
            m = hi - lo
            pre[lo:hi] = np.bincount(x.doc, minlength=m)
            whole[lo:hi] = np.bincount(x.doc, hit[at], m)
            total[lo:hi] = np.bincount(x.doc, n[at], m)
        return pre, whole, total

    return count


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_whole (counted by the shortcut), n_tokens."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counter(b.column(1).to_pylist()))], ["doc_id", "n_pretokens", "n_whole", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_pretokens bigint, n_whole bigint, n_tokens bigint")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
