"""SimHash near-duplicate groups by random bit sampling.

A document's fingerprint has 256 bits (at 128, chance brings unrelated short
documents within reach of real near copies). Each distinct lower-cased word votes on
every bit with its length, 12 bytes at most, as weight; two documents are near
duplicates when their fingerprints differ in at most ``max_distance`` bits.

Candidates: each of several hash tables samples coordinates of the fingerprint and
groups equal samples. The number of coordinates follows the number of distinct
fingerprints (one bucket for ``bucket_rows`` of them, ``bits`` at least), and the
number of tables follows from it: as many as find a pair at ``max_distance`` with
probability ``recall``. Buckets beyond ``bucket_cap`` are counted and cut by further
sampled coordinates of the same table before the shuffle, so no task gathers one
whole. Within a bucket every pair's distance is verified, and each connected part
is passed on as a star instead of all its pairs, so a group of thousands costs
thousands of edges. Equal fingerprints are joined before any table is built.

Groups are the connected components of verified pairs, found by alternating
large-star and small-star rounds, each written to the shared folder. A node is
(doc_id, text key); its neighbours' minimum is aggregated before the shuffle.

Defined results: null or blank text has no fingerprint and is in no group; rows
without a ``doc_id`` are in no group and stay; rows that repeat ``doc_id`` and text
are one document, of which the filter keeps one row; rows of one ``doc_id`` with
different texts are documents of their own; the kept document of a group is its
smallest by (doc_id, 64 bits of the text's BLAKE2b); very long texts are read whole;
``doc_id`` must be an integer; other columns are ignored by ``near_duplicates`` and
kept by the filter, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bitloom.llm.textops import Words, fresh, integer_id, mix, releasing, text_key
from bitloom.session import materialize, table


@dataclass(frozen=True)
class SimHashRules:
    max_distance: int = 48
    #: Of finding a pair at max_distance; nearer pairs are found more surely.
    recall: float = 0.94
    bits: int = 12
    bucket_rows: int = 1000
    bucket_cap: int = 2000
    seed: int = 7

    def plan(self, n: int) -> tuple[int, int]:
        """(coordinates, tables) for n distinct fingerprints."""
        bits = max(self.bits, ceil(log2(max(1, n) / self.bucket_rows)))
        hit = comb(BITS - self.max_distance, bits) / comb(BITS, bits)
        return bits, max(1, ceil(log(1 - self.recall) / log(1 - hit)))


BITS = 256
PARTS = ("f0", "f1", "f2", "f3")
_COLUMNS = ", ".join(f"{p} bigint" for p in PARTS)


def fingerprint(text: str | None) -> tuple[int, ...] | None:
    """A text's fingerprint as four signed 64-bit integers."""
    w = Words(text.lower() if text else text)
    if not len(w):
        return None
    h, at = np.unique(w.hashes(), return_index=True)
    weight = np.minimum(w.e[at] - w.s[at], 12).astype(np.float32)
    parts = np.stack([mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), mix(h + np.uint64(0x632BE59BD9B4E019)), mix(h ^ np.uint64(0x3C6EF372FE94F82B)), mix(h + np.uint64(0xBB67AE8584CAA73B))], 1)
    bits = np.unpackbits(parts.view(np.uint8).reshape(len(h), BITS // 8), axis=1)
    votes = 2 * (weight @ bits.astype(np.float32)) - weight.sum()
    return tuple(np.packbits(votes > 0).view(np.int64).tolist())


@releasing
def _fingerprint_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        texts = b.column(1).to_pylist()
        f = [fingerprint(t) for t in texts]
        key = [None if t is None else text_key(t.encode("utf-8", "surrogatepass")) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(key, pa.int64()), *[pa.array([x and x[k] for x in f], pa.int64()) for k in range(len(PARTS))]],
            ["doc_id", "key", *PARTS],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, f0, ...), null parts for texts without words."""
    return docs.select(integer_id(docs, "doc_id"), "text").mapInArrow(_fingerprint_batches, "doc_id bigint, key bigint, " + _COLUMNS)


def sampled_bits(tables: int, seed: int) -> np.ndarray:
    """Each table's own order of the coordinates; the first ones are its key,
    the next ones cut its oversized buckets."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS) for _ in range(tables)])


def _unpacked(f: np.ndarray) -> np.ndarray:
    """n x 4 integers to n x 256 bits."""
    return np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), BITS // 8), axis=1)


#: Further coordinates that travel with a row, to cut its buckets.
_MORE = 32


def _key_batches(order: np.ndarray, bits: int):
    """(table, bucket, more, doc_id, key, f0, ...) of each row in each table."""

    @releasing
    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = 1 << np.arange(max(bits, _MORE), dtype=np.int64)[::-1]
        tables = len(order)
        for b in it:
            n = b.num_rows
            if not n:
                continue
            own = [b.column(k).to_numpy() for k in range(2 + len(PARTS))]
            unpacked = _unpacked(np.stack(own[2:], 1))
            bucket = np.stack([unpacked[:, o[:bits]] @ value[-bits:] for o in order], 1)
            more = np.stack([unpacked[:, o[bits : bits + _MORE]] @ value[-_MORE:] for o in order], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(bucket.ravel()), pa.array(more.ravel()), *[pa.array(np.repeat(x, tables)) for x in own]], ["table", "bucket", "more", "doc_id", "key", *PARTS]
            )

    return emit


def linked(f: np.ndarray, order: np.ndarray, used: int, rules: SimHashRules) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (member, root) as positions within ``f``: a star for each connected
    part of the verified pairs, after cutting what exceeds the cap."""
    n = len(f)
    stack = [(np.arange(n), used)]
    while stack:
        at, k = stack.pop()
        if len(at) < 2:
            continue
        if len(at) > rules.bucket_cap and k < BITS:
            bit = _unpacked(f[at])[:, order[k]].astype(bool)
            stack += [(at[bit], k + 1), (at[~bit], k + 1)]
            continue
        g = f[at].view(np.uint64)
        label = np.arange(len(at))
        rows, cols = [], []
        for lo in range(0, len(at), 512):  # blocks bound the memory of a bucket
            d = np.bitwise_count(g[lo : lo + 512, None, 0] ^ g[None, :, 0])
            d += np.bitwise_count(g[lo : lo + 512, None, 1] ^ g[None, :, 1])
            i, j = np.nonzero(d <= rules.max_distance)  # half the bits rule out nearly all
            up = j > i + lo
            i, j = i[up], j[up]
            full = d[i, j] + np.bitwise_count(g[i + lo, 2] ^ g[j, 2]).astype(np.int64) + np.bitwise_count(g[i + lo, 3] ^ g[j, 3])
            near = full <= rules.max_distance
            rows.append(i[near] + lo)
            cols.append(j[near])
        i, j = np.concatenate(rows), np.concatenate(cols)
        if not len(i):
            continue
        while True:  # the smallest position spreads along the pairs
            new = label.copy()
            np.minimum.at(new, j, label[i])
            np.minimum.at(new, i, label[j])
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(at)))
        yield at[moved], at[label[moved]]


def _link_batches(order: np.ndarray, bits: int, rules: SimHashRules):
    @releasing
    def link(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (table, bucket, part); a bucket may go on in the next batch."""
        kept: list[np.ndarray] = []

        def close(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            pairs = []
            cuts = np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(1)) + 1
            for s, e in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))):
                if e - s > 1:
                    part = rows[s:e]
                    for x, y in linked(np.ascontiguousarray(part[:, 5:]), order[part[0, 0]], bits, rules):
                        pairs.append(np.concatenate([part[x, 3:5], part[y, 3:5]], 1))
            if pairs:
                p = np.unique(np.concatenate(pairs), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, k]) for k in range(4)], ["a", "ak", "b", "bk"])

        for batch in it:
            if not batch.num_rows:
                continue
            kept.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1))
            if (kept[0][0, :3] == kept[-1][-1, :3]).all():
                continue  # one bucket so far
            rows = np.concatenate(kept)
            same = (rows[:, :3] == rows[-1, :3]).all(1)
            cut = len(rows) - int(same.sum())
            kept = [rows[cut:]]
            yield from close(rows[:cut])
        if kept:
            yield from close(np.concatenate(kept))

    return link


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots themselves;
    a root is the smallest node of its connected component."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        # large star: every larger neighbour is linked to the smallest one; a minimum
        # and a join, so a hub's neighbours are never gathered
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours are linked to the smallest
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select("v", "m").toDF("a", "b").union(m.toDF("a", "b"))
        now = materialize(small.where("a <> b").distinct(), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen


def _node(i: str, k: str):
    return F.struct(F.col(i).alias("id"), F.col(k).alias("key"))


def _cut(keyed: DataFrame, rules: SimHashRules) -> DataFrame:
    """``keyed`` with ``part``: the further coordinates that cut its bucket, as many
    as bring an even bucket below the cap."""
    sizes = keyed.groupBy("table", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > rules.bucket_cap)
    depth = F.least(F.ceil(F.log2(F.col("n") / rules.bucket_cap)), F.lit(_MORE)).cast("int")
    sizes = materialize(sizes.select("table", "bucket", depth.alias("depth")), "simhash-buckets")
    if sizes.isEmpty():
        return keyed.withColumn("part", F.lit(0).cast("bigint"))
    part = F.coalesce(F.expr(f"shiftright(more, {_MORE} - depth)"), F.lit(0).cast("bigint"))
    return keyed.join(sizes, ["table", "bucket"], "left").withColumn("part", part)


def _groups(prints: DataFrame, rules: SimHashRules) -> DataFrame:
    """(doc_id, key, keep_id) for every document that another one stands for."""
    one = materialize(prints.where("doc_id is not null and f0 is not null").distinct(), "simhash-texts")
    # a third of all rows may share a fingerprint: its minimum is aggregated first
    reps = materialize(one.groupBy(*PARTS).agg(F.min(_node("doc_id", "key")).alias("rep"), F.count("*").alias("c")), "simhash-reps")
    bits, tables = rules.plan(reps.count())
    order = sampled_bits(tables, rules.seed)
    keyed = reps.select("rep.id", "rep.key", *PARTS).mapInArrow(_key_batches(order, bits), "table int, bucket bigint, more bigint, doc_id bigint, key bigint, " + _COLUMNS)
    cut = _cut(keyed, rules).select("table", "bucket", "part", "doc_id", "key", *PARTS)
    edges = cut.repartition("table", "bucket", "part").sortWithinPartitions("table", "bucket", "part").mapInArrow(_link_batches(order, bits, rules), "a bigint, ak bigint, b bigint, bk bigint")
    roots = components(edges.select(_node("a", "ak").alias("a"), _node("b", "bk").alias("b")))
    final = reps.join(roots, F.col("rep") == F.col("node"), "left").select(*PARTS, F.coalesce("root", "rep").alias("keep"), "c")
    return _by_print(one, materialize(final, "simhash-final")).where(_node("doc_id", "key") != F.col("keep")).select("doc_id", "key", F.col("keep.id").alias("keep_id"))


def _by_print(one: DataFrame, final: DataFrame) -> DataFrame:
    """Each document with its fingerprint's ``keep``. Fingerprints of more than a
    thousandth of all documents, at most a thousand of them, are broadcast; the
    join of the others has no hot key."""
    total = final.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    hot = F.col("c") * 1000 > total
    some = one.join(F.broadcast(final.where(hot & (F.col("c") > 1)).drop("c")), list(PARTS), "left")
    rest = some.where("keep is null").drop("keep").join(final.where(~hot | (F.col("c") == 1)).drop("c"), list(PARTS))
    return some.where("keep is not null").unionByName(rest)


def near_duplicates(docs: DataFrame, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """(doc_id, keep_id): every document of a group but the kept one, with the
    ``doc_id`` of the kept one. A ``doc_id`` with several texts may be there with its
    own id."""
    return _groups(materialize(fingerprints(docs), "simhash-prints"), rules).select("doc_id", "keep_id")


def keep_one_of_each_group(docs: DataFrame, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """``docs`` with one document of each group of near duplicates."""
    k, r, i = fresh(docs, "k"), fresh(docs, "r"), fresh(docs, "i")
    at = docs.columns.index("text")

    @releasing
    def add_key(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            key = [None if t is None else text_key(t.encode("utf-8", "surrogatepass")) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key, pa.int64())], [*b.schema.names, k])

    integer_id(docs, "doc_id")
    prints = materialize(fingerprints(docs), "simhash-prints")
    gone = _groups(prints, rules).select(F.col("doc_id").alias(i), F.col("key").alias(r))
    keyed = docs.mapInArrow(add_key, StructType([*docs.schema.fields, StructField(k, LongType())]))
    left = keyed.join(gone, (F.col("doc_id") == F.col(i)) & (F.col(k) == F.col(r)), "left_anti")
    again = materialize(prints.where("doc_id is not null and f0 is not null").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(i), F.col("key").alias(r)), "simhash-repeats")
    if again.isEmpty():
        return left.select(*docs.columns)
    # rows that repeat id and text: the one whose other columns are smallest stays
    same = (F.col("doc_id") == F.col(i)) & (F.col(k) == F.col(r))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = left.join(again, same, "left_semi").groupBy("doc_id", k).agg(F.min(F.struct("text", *[F.col(f"`{c}`") for c in others])).alias("o"))
    once = once.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"o.`{c}`").alias(c) for c in docs.columns])
    return left.join(again, same, "left_anti").select(*docs.columns).unionByName(once)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
SQL: dict[str, str] = {}
