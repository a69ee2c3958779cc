"""Vector best-fit packing of documents into training sequences.

Every item has three sizes: tokens, one document, and attention cost (tokens
squared). A bin has a capacity for each. Items are placed largest first; among
the open bins that have room in *every* dimension, the one with the best score
takes the item:

* ``dot``: the largest weighted dot product of item and residual, both as shares
  of capacity (the item goes where room of its own shape is plentiful)
* ``norm``: the smallest weighted norm of the residual that would remain (the
  tightest fit)

Ties go to the oldest bin; no fitting bin opens a new one. A document is cut only
if no empty bin could hold it, that is beyond ``longest`` tokens, the smaller of
``max_tokens`` and the root of ``max_attention``: into pieces of ``longest`` tokens
and a rest, so all of its tokens are packed.

Tokens are those of the byte-level vocabulary, counted as ``tokens.count_tokens``
does. Only (doc_id, token count) is shuffled. Equal items are counted before the
shuffle and dealt evenly to shards, all others go by a hash of both; a shard holds
about ``shard_documents`` of them, whatever the corpus and however often one item
repeats. Each shard is packed on its own and leaves one set of partly filled bins;
how documents meet depends on the number of shards and so on the number of
documents.

Defined results: null or empty text has no token and packs no item; blank text has
tokens; a null ``doc_id`` and repeated rows are items like any other; items of
equal size are packed in the order of ``doc_id`` (null last), then piece; very long
texts are counted whole and cut as said; other columns are ignored; an empty table
gives an empty result. ``doc_id`` must be an integer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.textops import integer_id, releasing
from bitloom.llm.tokens import VOCABULARY, token_counter
from bitloom.session import materialize, table


@dataclass(frozen=True)
class PackingRules:
    max_tokens: int = 4096
    max_documents: int = 16
    #: Two documents of 2,048 tokens, or one of 2,896.
    max_attention: int = 2 * 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.25, 0.5)
    score: str = "dot"
    #: Documents of a shard; only sizes are held, so memory is a few MB.
    shard_documents: int = 5_000
    vocabulary: str = VOCABULARY

    @property
    def longest(self) -> int:
        return min(self.max_tokens, isqrt(self.max_attention))


def token_sizes(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of each document."""

    @releasing
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter(b.column(1).to_pylist())[2])], ["doc_id", "n_tokens"])

    return docs.select(integer_id(docs, "doc_id"), "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")


def vector_best_fit(tokens: np.ndarray, rules: PackingRules) -> np.ndarray:
    """Bin number of each item, in the order given (largest first)."""
    cap = np.array([rules.max_tokens, rules.max_documents, rules.max_attention], np.float64)
    w = np.array(rules.weights, np.float64)
    size = np.stack([tokens, np.ones(len(tokens)), tokens.astype(np.float64) ** 2], 1) if len(tokens) else np.zeros((0, 3))
    out = np.zeros(len(tokens), np.int64)
    open_ids = np.zeros(256, np.int64)
    room = np.zeros((256, 3), np.float64)
    n_open = n_bins = 0
    least = tokens.min() if len(tokens) else 0
    for i in range(len(tokens)):
        d = size[i]
        k = -1
        if n_open:
            r = room[:n_open]
            fits = (r >= d).all(1)
            if fits.any():
                if rules.score == "dot":
                    s = (r / cap) @ (w * d / cap)
                    k = int(np.where(fits, s, -np.inf).argmax())
                else:
                    s = (((r - d) / cap) ** 2) @ w
                    k = int(np.where(fits, s, np.inf).argmin())
        if k < 0:
            if n_open == len(room):
                room, open_ids = np.concatenate([room, np.zeros_like(room)]), np.concatenate([open_ids, np.zeros_like(open_ids)])
            k = n_open
            room[k], open_ids[k] = cap, n_bins
            n_open += 1
            n_bins += 1
        room[k] -= d
        out[i] = open_ids[k]
        if room[k, 0] < least or room[k, 1] < 1 or room[k, 2] < float(least) ** 2:  # full: nothing left fits
            room[k : n_open - 1], open_ids[k : n_open - 1] = room[k + 1 : n_open].copy(), open_ids[k + 1 : n_open].copy()
            n_open -= 1
    return out


_OUT = "shard bigint, bin bigint, doc_id bigint, piece int, start_token bigint, n_tokens bigint"


def _pack_shard(rules: PackingRules):
    def pack(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py() if t.num_rows else 0
        times = t.column("copies").to_numpy()
        ids, n = (np.repeat(c.fill_null(0).to_numpy(), times) for c in (t.column("doc_id"), t.column("n_tokens")))
        null = np.repeat(t.column("doc_id").is_null().to_numpy(), times)
        pieces = -(-n // rules.longest)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * rules.longest
        size = np.minimum(rules.longest, n[row] - start)
        order = np.lexsort((piece, ids[row], null[row], -size))
        row, piece, start, size = row[order], piece[order], start[order], size[order]
        return pa.table(
            {
                "shard": pa.array(np.full(len(row), shard)),
                "bin": pa.array(vector_best_fit(size, rules)),
                "doc_id": pa.array(ids[row], mask=null[row]),
                "piece": pa.array(piece.astype(np.int32)),
                "start_token": pa.array(start),
                "n_tokens": pa.array(size),
            }
        )

    return pack


def pack_sizes(sizes: DataFrame, rules: PackingRules = PackingRules()) -> DataFrame:
    """Packs (doc_id, n_tokens); one row per packed piece."""
    if rules.longest < 1 or rules.max_documents < 1 or rules.score not in ("dot", "norm"):
        raise ValueError("a token must fit into an empty bin")
    counted = materialize(sizes.where("n_tokens > 0").groupBy("doc_id", "n_tokens").agg(F.count("*").alias("c")), "packing-sizes")
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    shards = max(1, round(total / rules.shard_documents))
    n = F.lit(shards)
    # a copy more in the first c % shards of the shards that an item is dealt to
    dealt = counted.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.col("c"), n) - 1)))
    dealt = dealt.select("doc_id", "n_tokens", F.pmod(F.pmod(F.xxhash64("doc_id", "n_tokens"), n) + F.col("k"), n).alias("shard"), (F.floor(F.col("c") / n) + (F.col("k") < F.col("c") % n).cast("bigint")).alias("copies"))
    # a given number of partitions, which adaptive execution doesn't merge into a few long tasks
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_pack_shard(rules), _OUT)


def pack_documents(docs: DataFrame, rules: PackingRules = PackingRules()) -> DataFrame:
    return pack_sizes(token_sizes(docs, rules.vocabulary), rules)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
SQL: dict[str, str] = {}
