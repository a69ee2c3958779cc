"""Symbol extraction: components, dictionaries, orders and distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators.codecs import Coded
from bitloom.plans.dialect import PRELUDES, Prelude, Template
from bitloom.session import materialize, spread

_XOR = " + ".join(f"bit_count($xor[a.r{k},b.r{k}])" for k in range(8))
_INK = " + ".join(f"bit_count(r{k})" for k in range(8))
PRELUDES["gink"] = Prelude(f"select *, cast({_INK} as bigint) as ink from glyph", ("glyph",))


#: Glyphs of a block, and pairs that are compared at once; they change no result.
BLOCK, TILE = 1 << 14, 1 << 16
_LEAST_BLOCKS = 16


def _pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lo, hi, ids, bits) of sorted (vec_id, bits)."""
    number = TaskContext.get().partitionId() << 32
    data = np.zeros((2, 0), np.int64)

    def row(ids: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        nonlocal number
        number += 1
        cols = [pa.array([x]) for x in (number, int(ids[0]), int(ids[-1]), ids.tobytes(), bits.tobytes())]
        return pa.RecordBatch.from_arrays(cols, ["block", "lo", "hi", "ids", "bits"])

    for b in it:
        data = np.concatenate([data, np.stack([c.to_numpy() for c in b.columns])], axis=1)
        while data.shape[1] >= BLOCK:
            yield row(*data[:, :BLOCK])
            data = data[:, BLOCK:]
    if data.shape[1]:
        yield row(*data)


def _over_pairs(spark: SparkSession, sf_dir: str, work: Callable, schema: str) -> DataFrame:
    """What ``work(a ids, a bits, b ids, b bits)`` yields for every two blocks of glyphs, of
    which pairs count where a's id is less than b's. A task holds two blocks at a time."""
    g = PRELUDES["glyph"].build(spark, sf_dir).where("vec_id is not null")
    word = " | ".join(f"shiftleft(r{k}, {56 - 8 * k})" for k in range(8))
    g = g.selectExpr("cast(vec_id as bigint) as vec_id", f"{word} as bits")
    ranges = max(_LEAST_BLOCKS, -(-g.count() // BLOCK))
    sorted_ = g.repartitionByRange(ranges, "vec_id").sortWithinPartitions("vec_id")
    blocks = materialize(sorted_.mapInArrow(_pack, "block bigint, lo bigint, hi bigint, ids binary, bits binary"), "glyph-blocks")
    names = blocks.select("block", "lo", "hi")
    met = names.selectExpr("block as p", "lo").crossJoin(names.selectExpr("block as q", "hi")).where("lo < hi").select("p", "q")
    sides = [met.join(blocks, F.col(k) == F.col("block")).select("p", "q", F.lit(k).alias("side"), "ids", "bits") for k in "pq"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {}
        for b in it:
            for side, ids, bits in zip(*(b.column(k).to_pylist() for k in ("side", "ids", "bits"))):
                at[side] = np.frombuffer(ids, np.int64), np.frombuffer(bits, np.uint64)
        yield from work(*at["p"], *at["q"])

    return spread(sides[0].union(sides[1]), "p", "q").groupBy("p", "q").applyInArrow(run, schema)


def _tiles(ids: np.ndarray, bits: np.ndarray, others: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """(first, last of a's glyphs, differing pixels by a and b, which of them are pairs or
    None for all)."""
    first = np.searchsorted(others, ids, "right")
    step = max(1, TILE // len(others))
    for lo in range(0, len(ids), step):
        hi = min(lo + step, len(ids))
        diff = np.bitwise_count(bits[lo:hi, None] ^ words)
        yield lo, hi, diff, np.arange(len(others)) >= first[lo:hi, None] if first[hi - 1] else None


def _nearest(ids: np.ndarray, bits: np.ndarray, others: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    near, far, n = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), len(others) - np.searchsorted(others, ids, "right")
    for lo, hi, diff, pair in _tiles(ids, bits, others, words):
        near[lo:hi] = (diff if pair is None else np.where(pair, diff, 255)).min(1)
        far[lo:hi] = (diff if pair is None else np.where(pair, diff, 0)).max(1)
    some = n > 0
    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, near, far, n)], ["a", "nearest", "farthest", "n"])


def glyph_wxor_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _over_pairs(spark, sf_dir, _nearest, "a bigint, nearest bigint, farthest bigint, n bigint")
    return found.groupBy("a").agg(F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"), F.sum("n").alias("n"))


def _close(near: Callable[[np.ndarray, np.ndarray | None], np.ndarray], with_ink: bool):
    def work(ids: np.ndarray, bits: np.ndarray, others: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        ink, inks = np.bitwise_count(bits), np.bitwise_count(words)
        for lo, hi, diff, pair in _tiles(ids, bits, others, words):
            least = np.minimum(ink[lo:hi, None], inks) if with_ink else None
            hit = near(diff, least)
            y, x = np.nonzero(hit if pair is None else hit & pair)
            if len(y):
                cols = [ids[lo + y], others[x], diff[y, x].astype(np.int64), *([least[y, x].astype(np.int64)] if with_ink else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "diff", "least_ink"][: len(cols)])

    return work


def glyph_xor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_pairs(spark, sf_dir, _close(lambda diff, least: diff <= 20, False), "a bigint, b bigint, diff bigint")


#: The greatest difference that each lesser ink allows.
_ALLOWED = np.array([600 * max(1, k) // 1000 for k in range(65)], np.uint8)


def lossy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_pairs(spark, sf_dir, _close(lambda diff, least: diff <= _ALLOWED[least], True), "a bigint, b bigint, diff bigint, least_ink bigint")


PRELUDES["gpair"] = Prelude(f"select a.vec_id as a, b.vec_id as b, cast({_XOR} as bigint) as diff, least(a.ink, b.ink) as least_ink from gink a join gink b on a.vec_id < b.vec_id", ("gink",))

TEMPLATES = {
    "cc_label": Template("select page, y, x, label from cc", ("cc",)),
    "cc_bbox": Template("select page, label, y0, x0, w, h, area from box", ("box",)),
    "cc_recompose": Template("select page, count(*) as ink, count(distinct label) as n_components from cc group by page", ("cc",)),
    "identity_dict": Template("select page, sym, w, h, bits, count(*) as n_instances from inst group by page, sym, w, h, bits", ("inst",)),
    "dedup_ratio": Template("select page, count(*) as n_components, count(distinct sym) as n_symbols, round(count(distinct sym) / count(*), 6) as dedup_ratio, max(area) as largest_area from inst group by page", ("inst",)),
    "dedup_gate": Template("select page, case when count(distinct sym) * 4 > count(*) * 3 then 'generic' else 'symbol' end as mode from inst group by page", ("inst",)),
    "symbol_height_order": Template("select page, sym, h, row_number() over (partition by page order by h, sym) - 1 as place from (select distinct page, sym, h from inst) s", ("inst",)),
    "instance_order": Template("select page, label, sym, row_number() over (partition by page order by y0, x0, label) - 1 as place from inst", ("inst",)),
    "baseline_strips": Template("select page, y0 as strip, count(*) as n_instances, max(h) as height, x0_first from (select *, min(x0) over (partition by page, y0) as x0_first from inst) i group by page, y0, x0_first", ("inst",)),
    "instance_deltas": Template("select page, label, x0 - lag(x0, 1, 0) over (partition by page, y0 order by x0, label) as dx, y0 - lag(y0, 1, 0) over (partition by page order by y0, x0, label) as dy from inst", ("inst",)),
    "refinement_promotions": Template("select page, sym, count(*) as n from inst where area >= 3 group by page, sym having count(*) >= 2", ("inst",)),
    "glyph_xor_pairs": Coded("select a, b, diff from gpair where diff <= 20", ("gpair",), glyph_xor_pairs),
    "glyph_wxor_distance": Coded("select a, min(diff) as nearest, max(diff) as farthest, count(*) as n from gpair group by a", ("gpair",), glyph_wxor_distance),
    "lossy_edges": Coded("select a, b, diff, least_ink from gpair where diff * 1000 <= 600 * greatest(1, least_ink)", ("gpair",), lossy_edges),
}
