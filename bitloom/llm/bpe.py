"""Byte-level BPE encoding and decoding over a global table of distinct words.

Encoding:

1. Explode: one scan splits every text into pre-tokens. A chunk (consecutive
   documents of about ``chunk_chars`` characters) numbers its distinct words, the
   most frequent ones first; its documents become the numbers by position.
2. The distinct words of all chunks are shuffled by word, to as many buckets as
   there are chunks' worth of text. A bucket encodes each distinct word of the corpus
   once and gives the ids back to every chunk that has the word.
3. Each chunk's ids meet its documents, which are reassembled by position.

Numbering words within a chunk is the aggregation before the shuffle: a word that
is a third of all pre-tokens is one entry per chunk. What is shuffled is packed:
a bucket's words of a chunk are sorted, front-coded and compressed. Words are told
apart by their bytes, never by a hash. ``round_trip`` says whether the ids decode
to a text of the same length and BLAKE2b digest (128 bits) as the text's bytes.

Decoding joins ids with the token-byte table, which has the size of the vocabulary
and may thus be broadcast; each chunk of documents sends every id once.

Defined results: null text has null ids and a null round trip; empty text has no
ids; texts and words of any length are encoded whole; repeated rows each get their
ids; ``doc_id`` may be of any type; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.pretokens import Batch
from bitloom.llm.textops import released, releasing
from bitloom.llm.tokens import VOCABULARY, merger, slices, vocabulary
from bitloom.session import materialize, table

#: Characters of a chunk, and of the text that a bucket of words stands for; it
#: bounds a task's memory and changes no result.
CHUNK_CHARS = 1 << 24


def pack_numbers(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seven bits a byte, least first; the end of each number)."""
    size = 1 + sum((v >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    at = ends - size
    for k in range(5):
        more = size > k
        out[at[more] + k] = (v[more] >> (7 * k) & 127) | (size[more] > k + 1).astype(np.int64) << 7
    return out, ends


def unpack_numbers(b: np.ndarray) -> np.ndarray:
    if not len(b):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(b < 128)[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)


def _gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts ``at`` of an array cut at ``ends``, in a row; and their lengths."""
    size = np.diff(ends, prepend=0)
    n = size[at]
    begin = (ends - size)[at]
    return flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _squeeze(*parts: np.ndarray) -> bytes:
    """Arrays of bytes as one compressed value."""
    data = b"".join(np.uint32(len(p)).tobytes() + p.tobytes() for p in parts)
    return np.uint32(len(data)).tobytes() + pa.compress(data, "zstd", asbytes=True)


def _unsqueeze(value: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(value, np.uint32, 1)[0])
    data = np.frombuffer(pa.decompress(value[4:], size, "zstd"), np.uint8)
    out, at = [], 0
    while at < size:
        n = int(data[at : at + 4].view(np.uint32)[0])
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def pack_words(words: pa.Array) -> list[np.ndarray]:
    """Sorted words, front-coded: shared lengths, lengths of the rests, the rests."""
    data, ends = _values(words)
    size = np.diff(ends, prepend=0)
    start = ends - size
    shared = np.zeros(len(size), np.int64)
    same = np.arange(1, len(size))
    for k in range(31):  # a prefix beyond is kept with the rest
        same = same[np.minimum(size[same], size[same - 1]) > k]
        same = same[data[start[same] + k] == data[start[same - 1] + k]]
        if not len(same):
            break
        shared[same] = k + 1
    rest = size - shared
    flat = data[np.repeat(start + shared - (np.cumsum(rest) - rest), rest) + np.arange(rest.sum())]
    return [shared.astype(np.uint8), pack_numbers(rest)[0], flat]


def unpack_words(shared: np.ndarray, rests: np.ndarray, flat: np.ndarray) -> pa.Array:
    shared, rest = shared.astype(np.int64), unpack_numbers(rests)
    size = shared + rest
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[np.repeat(start + shared - (np.cumsum(rest) - rest), rest) + np.arange(rest.sum())] = flat
    for k in range(int(shared.max()) if len(shared) else 0):  # byte k comes from the last word that has its own
        owner = np.maximum.accumulate(np.where(shared <= k, np.arange(len(size)), 0))
        taken = shared > k
        out[start[taken] + k] = out[start[owner[taken]] + k]
    offsets = np.append(start, len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _values(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, end of each value) of an array of byte strings without nulls."""
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    return np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


# ---- encoding ------------------------------------------------------------------------


def _key(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


#: Numbers below take two bytes at most.
_SHORT = 1 << 14


def _numbers(codes: bytes, n: int) -> np.ndarray:
    """The numbers of a bucket's n words of a chunk."""
    base, steps, ranks = map(unpack_numbers, _unsqueeze(codes))
    out = np.zeros(n, np.int64)
    place = np.cumsum(steps)
    rare = np.ones(n, bool)
    rare[place] = False
    out[place] = ranks
    out[rare] = (base[0] if len(base) else 0) + np.arange(rare.sum())
    return out


class _Chunk:
    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.words: list[pa.DictionaryArray] = []
        self.size = 0

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        x = Batch(texts)
        self.words.append(x.words())
        data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        lengths = [None if t is None else len(d) for t, d in zip(texts, data)]
        self.docs.append((ids, lengths, b"".join(map(_key, data)), np.bincount(x.doc, minlength=len(texts))))
        self.size += sum(len(t) for t in texts if t)

    def rows(self, chunk: int, buckets: int) -> Iterator[pa.RecordBatch]:
        words = pa.chunked_array(self.words).unify_dictionaries()
        distinct = words.chunk(0).dictionary
        seen = sum(np.bincount(c.indices.to_numpy(), minlength=len(distinct)) for c in words.chunks)
        bucket = np.fromiter(map(crc32, distinct.to_pylist()), np.int64, len(distinct)) % buckets
        by_word = pc.sort_indices(distinct).to_numpy().astype(np.int64)
        by_bucket = by_word[np.argsort(bucket[by_word], kind="stable")]
        # frequent words get small numbers, which take fewer bytes; the others go by place
        hot = np.argsort(-seen, kind="stable")[:_SHORT]
        rank = np.full(len(distinct), -1)
        rank[hot] = np.arange(len(hot))
        number = np.empty(len(distinct), np.int64)
        rare = by_bucket[rank[by_bucket] < 0]
        number[rare] = len(hot) + np.arange(len(rare))
        number[hot] = rank[hot]
        kind = self.docs[0][0].type
        for part, (ids, lengths, digests, counts) in zip(words.chunks, self.docs):
            codes = _squeeze(pack_numbers(number[part.indices.to_numpy()])[0])
            yield _exploded(chunk, kind, docs=ids, lengths=lengths, digests=digests, counts=counts.tolist(), codes=codes)
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        for k in range(buckets):
            own = by_bucket[ends[k - 1] if k else 0 : ends[k]]
            if len(own):
                place = np.flatnonzero(rank[own] >= 0)
                base = number[own[rank[own] < 0][:1]]
                codes = _squeeze(*(pack_numbers(x)[0] for x in (base, np.diff(place, prepend=0), rank[own[place]])))
                yield _exploded(chunk, kind, bucket=k, codes=codes, words=_squeeze(*pack_words(distinct.take(pa.array(own)))))


def _exploded(chunk: int, kind: pa.DataType, bucket=None, docs=None, lengths=None, digests=None, counts=None, codes=None, words=None) -> pa.RecordBatch:
    ids = pa.nulls(1, pa.list_(kind)) if docs is None else pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
    cols = [pa.array([chunk]), pa.array([bucket], pa.int32()), ids, pa.array([lengths], pa.list_(pa.int64())), pa.array([digests], pa.binary()), pa.array([counts], pa.list_(pa.int64())), pa.array([codes], pa.binary()), pa.array([words], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["chunk", "bucket", "docs", "lengths", "digests", "counts", "codes", "words"])


def _explode(chunk_chars: int, buckets: int):
    @releasing
    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held = _Chunk()
        for b in it:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts):
                held.add(b.column(0).slice(lo, hi - lo), texts[lo:hi])
                if held.size >= chunk_chars:
                    yield from held.rows(chunk, buckets)
                    chunk, held = chunk + 1, _Chunk()
        if held.docs:
            yield from held.rows(chunk, buckets)

    return emit


def _encode_bucket(path: str):
    """Each distinct word of a bucket is encoded once; every chunk gets the ids of its
    own words, in the order of its words."""
    kind = np.uint16 if max(vocabulary(path).values()) < 1 << 16 else np.uint32

    @released
    def encode(t: pa.Table) -> pa.Table:
        m = merger(path)
        parts = [unpack_words(*_unsqueeze(x)) for x in t.column("words").to_pylist()]
        words = pa.chunked_array([p.dictionary_encode() for p in parts], pa.dictionary(pa.int32(), pa.binary())).unify_dictionaries()
        distinct = words.chunk(0).dictionary if parts else pa.array([], pa.binary())
        flat, sizes = [], []
        for lo in range(0, len(distinct), 1 << 15):
            ids, ends = m.merge(distinct.slice(lo, 1 << 15))
            flat.append(ids.astype(kind))
            sizes.append(np.diff(ends, prepend=0))
        flat, ends = (np.concatenate(flat), np.cumsum(np.concatenate(sizes))) if flat else (np.zeros(0, kind), np.zeros(0, np.int64))
        out = []
        for part in words.chunks:
            ids, n = _gather(flat, ends, part.indices.to_numpy())
            # the bytes of all ids by significance
            out.append(_squeeze(pack_numbers(n)[0], ids.view(np.uint8).reshape(len(ids), -1).T.ravel()))
        return pa.table({"chunk": t.column("chunk"), "codes": t.column("codes"), "ids": pa.array(out, pa.binary())})

    return encode


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table as all bytes and the end of each id's."""
    ranks = vocabulary(path)
    parts = [b""] * (max(ranks.values()) + 1)
    for word, i in ranks.items():
        parts[i] = word
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def _assemble(kind: pa.DataType, path: str):
    width = 2 if max(vocabulary(path).values()) < 1 << 16 else 4

    @released
    def assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
        numbers, counts, values = [], [], []
        for code, ids in zip(words.column("codes").to_pylist(), words.column("ids").to_pylist()):
            n, planes = _unsqueeze(ids)
            counts.append(unpack_numbers(n))
            numbers.append(_numbers(code, len(counts[-1])))
            values.append(np.ascontiguousarray(planes.reshape(width, -1).T).view(np.uint16 if width == 2 else np.uint32).ravel())
        order = np.argsort(np.concatenate(numbers)) if numbers else np.zeros(0, np.int64)
        if numbers and not np.array_equal(np.concatenate(numbers)[order], np.arange(len(order))):
            raise ValueError("a word of a chunk was lost")
        flat, ends = (np.concatenate(values), np.cumsum(np.concatenate(counts))) if numbers else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        table_bytes, table_ends = token_bytes(path)
        out, sizes, ok = [], [], []
        for lengths, digests, n, code in zip(*(docs.column(c).to_pylist() for c in ("lengths", "digests", "counts", "codes"))):
            at = unpack_numbers(_unsqueeze(code)[0]) if any(n) else np.zeros(0, np.int64)
            ids, size = _gather(flat, ends, order[at])
            out.append(ids.astype(np.int32))
            stop = np.concatenate(([0], np.cumsum(size)))[np.cumsum(n)]
            text, token_size = _gather(table_bytes, table_ends, out[-1])
            text_stop = np.concatenate(([0], np.cumsum(token_size)))[stop]
            data = text.tobytes()
            for k, (length, a, b, p, q) in enumerate(zip(lengths, [0, *stop[:-1]], stop, [0, *text_stop[:-1]], text_stop)):
                sizes.append(None if length is None else int(b - a))
                ok.append(None if length is None else q - p == length and _key(data[p:q]) == digests[16 * k : 16 * k + 16])
        ends = np.cumsum([0, *(x or 0 for x in sizes)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int32()), mask=pa.array([x is None for x in sizes], pa.bool_()))
        return pa.table({"doc_id": docs.column("docs").combine_chunks().flatten().cast(kind), "ids": lists, "n_tokens": pa.array(sizes, pa.int64()), "round_trip": pa.array([x if x is None else bool(x) for x in ok], pa.bool_())})

    return assemble


def encode_documents(docs: DataFrame, path: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (the decoded ids are the text)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0))).first()[0]
    buckets = 1 + total // chunk_chars
    schema = f"chunk bigint, bucket int, docs array<{kind}>, lengths array<bigint>, digests binary, counts array<bigint>, codes binary, words binary"
    exploded = materialize(docs.mapInArrow(_explode(chunk_chars, buckets), schema), "bpe-exploded")
    words = exploded.where("bucket is not null").select("chunk", "bucket", "codes", "words")
    found = words.groupBy("bucket").applyInArrow(_encode_bucket(path), "chunk bigint, codes binary, ids binary")
    own = exploded.where("bucket is null").select(F.col("chunk").alias("part"), "docs", "lengths", "digests", "counts", "codes")
    return own.groupBy("part").cogroup(found.groupBy("chunk")).applyInArrow(_assemble(_arrow_type(docs), path), f"doc_id {kind}, ids array<int>, n_tokens bigint, round_trip boolean")


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)


# ---- decoding ------------------------------------------------------------------------


def token_table(spark: SparkSession, path: str = VOCABULARY) -> DataFrame:
    """(id, bytes): the token-byte table; one row per entry of the vocabulary."""
    ranks = vocabulary(path)
    return spark.createDataFrame(pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))


def _distinct_ids(chunk_ids: int):
    """(chunk, id, doc_id, ids): each chunk's distinct ids and its documents."""

    @releasing
    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        seen: list[np.ndarray] = []
        size = 0
        for b in it:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.nulls(n, pa.int32()), part.column(0), part.column(1)], ["chunk", "id", "doc_id", "ids"])
                flat = part.column(1).flatten().drop_null().to_numpy()
                seen.append(np.unique(flat))
                size += len(flat)
                if size >= chunk_ids:
                    yield rows(chunk, seen, part)
                    chunk, seen, size = chunk + 1, [], 0
        if seen:
            yield rows(chunk, seen, part)

    def rows(chunk: int, seen: list[np.ndarray], like: pa.RecordBatch) -> pa.RecordBatch:
        ids = np.unique(np.concatenate(seen)).astype(np.int32)
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(ids), pa.nulls(n, like.column(0).type), pa.nulls(n, like.column(1).type)], ["chunk", "id", "doc_id", "ids"])

    return emit


#: Ids of which the bytes are formed at a time; a document is never cut.
_SLICE_IDS = 1 << 18


def _by_ids(lists: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(lists, their sizes): parts with about ``_SLICE_IDS`` ids."""
    size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // _SLICE_IDS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for lo, hi in zip(cuts, cuts[1:]):
        yield lists.slice(lo, hi - lo), size[lo:hi]


def _decode_chunk(kind: pa.DataType):
    @released
    def decode(docs: pa.Table, tokens: pa.Table) -> pa.Table:
        tokens = tokens.sort_by("id")
        # one entry more stands for null ids
        keys = np.append(tokens.column("id").to_numpy(), np.iinfo(np.int64).max)
        known = np.append(tokens.column("bytes").is_valid().to_numpy(), False)
        flat, ends = _values(tokens.column("bytes").combine_chunks().fill_null(b""))
        ends = np.append(ends, len(flat))
        out: list[pa.Array] = []
        for lists, size in (x for c in docs.column("ids").chunks if len(c) for x in _by_ids(c)):
            ids = lists.flatten().cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, ids)
            whole = np.bincount(np.repeat(np.arange(len(size)), size)[~known[at]], minlength=len(size)) == 0
            whole &= lists.is_valid().to_numpy(zero_copy_only=False)
            data, n = _gather(flat, ends, at)
            stop = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(size)))]
            data = data.tobytes()
            texts = [data[a:b].decode("utf-8", "replace") if w else None for a, b, w in zip(stop[:-1].tolist(), stop[1:].tolist(), whole.tolist())]
            out.append(pa.array(texts, pa.string()))
        return pa.table({"doc_id": docs.column("doc_id").cast(kind), "text": pa.chunked_array(out, pa.string())})

    return decode


def decode_documents(encoded: DataFrame, path: str = VOCABULARY, chunk_ids: int = 1 << 23) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), by a join of each chunk's distinct ids with
    the token-byte table; bytes that are no UTF-8 become U+FFFD; null ids, or an id
    that is null or not in the vocabulary, give a null text."""
    encoded = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    split = materialize(encoded.mapInArrow(_distinct_ids(chunk_ids), f"chunk bigint, id int, doc_id {kind}, ids array<int>"), "bpe-decode")
    tokens = split.where("id is not null").select("chunk", "id").join(F.broadcast(token_table(encoded.sparkSession, path)), "id", "left")
    docs = split.where("id is null").select(F.col("chunk").alias("part"), "doc_id", "ids")
    return docs.groupBy("part").cogroup(tokens.groupBy("chunk")).applyInArrow(_decode_chunk(_arrow_type(encoded)), f"doc_id {kind}, text string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def bpe_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_documents(encode_documents(table(spark, sf_dir, "documents")))


QUERIES = {"op8_bpe": op8_bpe, "bpe_decode": bpe_decode}
SQL = {"bpe_decode": "select doc_id, text from documents"}
