"""Exact top-k search over vectors with multi-resolution segment statistics.

A vector is cut into segments; at each resolution (few segments to many) a segment
is known by its mean and its deviation. For two vectors the sum over segments of
``length * ((mean difference)^2 + (deviation difference)^2)`` never exceeds their
squared Euclidean distance, and scaled by ``sqrt(length)`` the statistics are
themselves vectors whose squared distance is that bound. Pairs are discarded coarse
to fine; only survivors of all levels get an exact distance, in double precision.

Before it is cut, a vector is turned by an orthogonal matrix, which keeps all
distances and moves what tells vectors apart to the front (principal axes of at most
``sample_rows`` vectors, the smallest by hash of ``vec_id``; they affect speed
alone). So a resolution is: the first coordinates as segments of their own, the
others in a few long segments. At the finest one every segment has length 1.

Queries are the rows that meet a condition on ``vec_id``, against all other rows:

1. Vectors are ordered by the interleaved bits of their first turned coordinates and
   cut into blocks of ``block_rows`` by range, so a block holds similar vectors.
2. Each block finds its own queries' top k. That gives every query a radius which its
   true neighbours can't exceed.
3. The queries of some neighbouring blocks, about ``query_rows``, are a group. A block
   whose box of coarse statistics is further from the group's box than the group's
   largest radius needs no look; all other (group, block) are searched.
4. The lists of each query are merged.

Blocks and groups are of bounded size, so a task's memory is too, whatever the corpus.

Defined results: a null vector or one with null, infinite or NaN entries, an
empty one, or one without ``vec_id`` is neither query nor neighbour; vectors of
different length aren't compared; entries are read as doubles; rows that repeat a
``vec_id`` are one vector (the smallest as an array); equal distances are ordered by
``vec_id``, also across blocks; with fewer than k other vectors a query has as many
neighbours as there are; vectors of any length are read whole, the turning matrix has
the square of that length; ``vec_id`` must be an integer; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitloom.llm.textops import integer_id
from bitloom.session import materialize, table


@dataclass(frozen=True)
class TopKRules:
    k: int = 10
    #: Coarse to fine: first coordinates that are segments of their own, and
    #: segments of the others. The finest level, every coordinate, follows always.
    levels: tuple[tuple[int, int], ...] = ((2, 1), (8, 2), (24, 4))
    block_rows: int = 16_384
    query_rows: int = 4_096
    sample_rows: int = 4_096
    #: Rows before and after a query, in the order of the blocks, that give its
    #: first radius. It affects speed alone.
    window: int = 48


def segment_cuts(d: int, lead: int, others: int) -> np.ndarray:
    lead = min(lead, d)
    rest = np.linspace(lead, d, min(others, d - lead) + 1).astype(np.int64) if lead < d else np.array([d])
    return np.unique(np.concatenate([np.arange(lead), rest]))


def segment_statistics(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Means, and deviations of segments longer than 1, times sqrt(segment length)."""
    size = np.diff(cuts).astype(np.float64)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    long = size > 1
    with np.errstate(over="ignore", invalid="ignore"):
        square = np.add.reduceat(x * x, cuts[:-1], axis=1)[:, long] / size[long]
        deviation = np.sqrt(np.maximum(square - mean[:, long] ** 2, 0))
    return np.concatenate([mean * np.sqrt(size), deviation * np.sqrt(size[long])], 1)


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All squared distances in single precision, and the most that rounding can
    have added to each row's: 2nu(p + q) for products of length n, unit u."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _raw_squares(a, b)


def _raw_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    slack = (a.shape[1] + 8) * np.float32(1.2e-7) * (p + (q.max() if len(q) else 0)) + np.float32(1e-12)
    d = a @ b.T
    d *= -2
    d += p[:, None]
    d += q[None, :]
    return d, slack


def distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact distances of the pairs (i, j), in pieces of bounded size."""
    out = np.empty(len(i))
    step = max(1, (8 << 20) // max(1, 8 * a.shape[1]))
    for s in range(0, len(i), step):
        d = a[i[s : s + step]] - b[j[s : s + step]]
        out[s : s + step] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


Axes = dict[int, np.ndarray]


@dataclass
class Side:
    """Vectors with their statistics at every level; ``stats`` are single precision,
    which only discards pairs."""

    ids: np.ndarray
    x: np.ndarray
    stats: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, axes: Axes, rules: TopKRules) -> Side:
        d = x.shape[1]
        y = x @ axes[d] if d in axes else x
        cuts = [segment_cuts(d, *level) for level in rules.levels if sum(level) < d]
        return cls(ids, x, [*(segment_statistics(y, c).astype(np.float32) for c in cuts), y.astype(np.float32)])

    def only(self, at: np.ndarray) -> Side:
        return Side(self.ids[at], self.x[at], [s[at] for s in self.stats])


def _pair_bounds(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.float32)
    step = max(1, (4 << 20) // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        d = a[i[s : s + step]] - b[j[s : s + step]]
        out[s : s + step] = np.einsum("ij,ij->i", d, d)
    return out


def search(q: Side, x: Side, radius: np.ndarray, rules: TopKRules, compared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data row, distance): each query's k best within its radius,
    by (distance, id); a row isn't its own neighbour. ``compared`` gets the pairs
    that come to each level, and those that get an exact distance."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q.ids), 256):
        hi = min(lo + 256, len(q.ids))
        limit = (radius[lo:hi] ** 2 * (1 + 1e-6)).astype(np.float32)
        cols, alive, pairs = np.arange(len(x.ids)), None, None
        seen = []
        for level, (a, b) in enumerate(zip(q.stats, x.stats)):
            a = a[lo:hi]
            seen.append((hi - lo) * len(cols) if pairs is None else len(pairs[0]))
            if pairs is not None:  # few are left: each by itself
                i, j = pairs
                slack = (a.shape[1] + 8) * np.float32(2.4e-7) * (np.einsum("ij,ij->i", a, a) + np.float32(_most(b)))
                near = ~(_pair_bounds(a, b, i, j) > limit[i] + slack[i])
                pairs = i[near], j[near]
                continue
            d, slack = _squares(a, b[cols])
            if level == len(q.stats) - 1 and d.shape[1] > rules.k:
                # the finest bound is the distance itself: the k-th here (one more, for itself) is a radius too
                kth = np.partition(d, rules.k, axis=1)[:, rules.k]
                limit = np.minimum(limit, kth * np.float32(1 + 1e-6) + slack)
            near = ~(d > (limit + slack)[:, None])  # what overflows stays
            alive = near if alive is None else near & alive
            some = alive.any(0)
            if not some.all():
                cols, alive = cols[some], alive[:, some]
            if alive.size == 0 or alive.mean() < 0.1 or level == len(q.stats) - 1:
                i, j = np.nonzero(alive)
                pairs = i, cols[j]
        i, j = pairs
        i = i + lo
        other = q.ids[i] != x.ids[j]
        i, j = i[other], j[other]
        if compared is not None:
            compared[:] = [p + r for p, r in zip(compared or [0] * (len(seen) + 1), [*seen, len(i)])]
        dist = distances(q.x, x.x, i, j)
        ok = dist <= radius[i]
        found.append(_best(i[ok], j[ok], dist[ok], x.ids, rules.k))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def _most(b: np.ndarray) -> float:
    return float(np.einsum("ij,ij->i", b, b).max()) if len(b) else 0.0


def _best(i: np.ndarray, j: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids[j], dist, i))
    i, j, dist = i[order], j[order], dist[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], dist[rank < k]


def _first_radius(x: np.ndarray, rows: np.ndarray, rules: TopKRules) -> np.ndarray:
    """An upper bound of the k-th distance of some rows, from their neighbours in order."""
    n = len(x)
    if n <= rules.k:
        return np.full(len(rows), np.inf)
    half = max(rules.window, rules.k)
    out = np.empty(len(rows))
    step = max(1, (16 << 20) // (8 * x.shape[1] * (2 * half + 1)))
    for lo in range(0, len(rows), step):
        own = rows[lo : lo + step]
        start = np.clip(own - half, 0, max(0, n - 2 * half - 1))
        near = start[:, None] + np.arange(min(n, 2 * half + 1))[None, :]
        d = distances(x, x, np.repeat(own, near.shape[1]), near.ravel()).reshape(near.shape)
        d[near == own[:, None]] = np.inf
        out[lo : lo + step] = np.partition(d, rules.k - 1, axis=1)[:, rules.k - 1]
    return out


def _matrix(c: pa.ChunkedArray) -> np.ndarray:
    a = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(a), -1) if len(a) else flat.reshape(0, 1)


def principal_axes(sample: list[np.ndarray]) -> Axes:
    """For each length of vectors in the sample, its principal axes as columns."""
    out: Axes = {}
    for d in {len(x) for x in sample}:
        x = np.stack([v for v in sample if len(v) == d])
        with np.errstate(over="ignore", invalid="ignore"):
            x = (x - x.mean(0)) / max(np.abs(x).max(), 1e-300)
        if len(x) > 1 and np.isfinite(x).all():
            out[d] = np.linalg.svd(x.T @ x)[0]
    return out


def _order_keys(axes: Axes):
    """(vec_id, embedding, place): place interleaves the bits of the first four turned
    coordinates, each as a monotonic integer."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            place = np.zeros(b.num_rows, np.int64)
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = _matrix(lists.take(pa.array(at)))
                with np.errstate(over="ignore"):
                    s = (x @ axes[d] if d in axes else x)[:, :4].astype(np.float32)
                u = np.ascontiguousarray(s).view(np.int32).astype(np.int64)
                u = np.where(u < 0, ~u & 0xFFFFFFFF, u | 0x80000000) >> 17
                key = np.zeros(len(at), np.int64)
                for bit in range(14, -1, -1):
                    for c in range(u.shape[1]):
                        key = (key << 1) | ((u[:, c] >> bit) & 1)
                place[at] = key
            yield pa.RecordBatch.from_arrays([b.column(0), lists, b.column(2), pa.array(place)], ["vec_id", "embedding", "query", "place"])

    return emit


_LOCAL = "block bigint, vec_id bigint, embedding array<double>, radius double, low array<double>, high array<double>, near array<struct<id:bigint,distance:double>>"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values)


def _local(axes: Axes, rules: TopKRules):
    """The block's queries with their radius and best, and a row with its boxes."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending"), ("vec_id", "ascending")])
        side = Side.of(t.column("vec_id").to_numpy(), _matrix(t.column("embedding")), axes, rules)
        rows = np.flatnonzero(t.column("query").to_numpy(zero_copy_only=False))
        q = side.only(rows)
        i, j, dist = search(q, side, _first_radius(side.x, rows, rules), rules)
        n = len(rows)
        count = np.bincount(i, minlength=n)
        ends = np.cumsum(count)
        radius = np.full(n, np.inf)
        full = count >= rules.k
        radius[full] = dist[ends[full] - 1]
        near = _lists(pa.StructArray.from_arrays([pa.array(side.ids[j]), pa.array(dist)], ["id", "distance"]), ends)
        box = side.stats[0].astype(np.float64)
        # what overflows has no bounds
        low, high = (np.where(np.isfinite(box), box, v) for v in (-np.inf, np.inf))
        flat = lambda v: _lists(pa.array(v[rows].ravel()), np.arange(1, n + 1) * box.shape[1])
        block = t.column("block")[0].as_py() if t.num_rows else 0
        queries = pa.table({"block": pa.array(np.full(n, block)), "vec_id": pa.array(q.ids, pa.int64()), "embedding": t.column("embedding").take(pa.array(rows)), "radius": pa.array(radius), "low": flat(low), "high": flat(high), "near": near})
        whole = pa.table({"block": pa.array([block]), "vec_id": pa.nulls(1, pa.int64()), "embedding": pa.nulls(1, pa.list_(pa.float64())), "radius": pa.nulls(1, pa.float64()), "low": pa.array([low.min(0)], pa.list_(pa.float64())), "high": pa.array([high.max(0)], pa.list_(pa.float64())), "near": pa.nulls(1, near.type)})
        return pa.concat_tables([queries, whole.cast(queries.schema)])

    return run


_FOUND = "vec_id bigint, id bigint, distance double"


def _across(axes: Axes, rules: TopKRules):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            # a query has met its own block before
            left = left.filter(pa.compute.not_equal(left.column("home"), right.column("block")[0]))
        if left.num_rows and right.num_rows:
            x = Side.of(right.column("id").to_numpy(), _matrix(right.column("data")), axes, rules)
            q = Side.of(left.column("vec_id").to_numpy(), _matrix(left.column("embedding")), axes, rules)
            radius = left.column("radius").to_numpy()
            low, high = x.stats[0].min(0), x.stats[0].max(0)
            with np.errstate(over="ignore"):
                gap = np.maximum(np.maximum(low - q.stats[0], q.stats[0] - high), 0).astype(np.float64)
                rows = np.flatnonzero(~((gap**2).sum(1) > radius**2 * 1.00001 + 1e-9))
            q = q.only(rows)
            i, j, d = search(q, x, radius[rows], rules)
            cols = [q.ids[i], x.ids[j], d]
        return pa.table({"vec_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "distance": pa.array(cols[2], pa.float64())})

    return run


def _boxes(rows: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """(key, low, high): the smallest and largest entries of arrays, by position."""
    at = rows.select(key, F.posexplode(F.arrays_zip(F.col(low).alias("a"), F.col(high).alias("b"))).alias("pos", "v"))
    each = at.groupBy(key, "pos").agg(F.min("v.a").alias("a"), F.max("v.b").alias("b"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("v")).select(key, F.col("v.a").alias("low"), F.col("v.b").alias("high"))


def nearest(vectors: DataFrame, rules: TopKRules = TopKRules(), queries: str = "true") -> DataFrame:
    """vec_id, rank (from 1), neighbor_id, distance of the k nearest of every vector
    whose ``vec_id`` meets the condition ``queries``."""
    e = F.col("embedding").cast("array<double>")
    usable = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    clean = vectors.select(integer_id(vectors, "vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & usable)
    one = materialize(clean.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "topk-vectors")
    # a sample of bounded size, whatever the corpus
    axes = principal_axes([np.array(r.embedding) for r in one.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rules.sample_rows).collect()])
    keyed = one.withColumn("query", F.expr(queries)).mapInArrow(_order_keys(axes), "vec_id bigint, embedding array<double>, query boolean, place bigint")
    total, asked = one.agg(F.count("*"), F.coalesce(F.sum(F.expr(f"cast(({queries}) as bigint)")), F.lit(0))).first()
    blocks = max(1, -(-total // rules.block_rows))
    # AQE leaves a given number of ranges alone; vec_id splits runs of equal places
    cut = keyed.withColumn("d", F.size("embedding")).repartitionByRange(blocks, "d", "place", "vec_id")
    cut = materialize(cut.withColumn("block", F.spark_partition_id() + F.col("d").cast("bigint") * F.lit(1 << 32)), "topk-blocks")
    local = materialize(cut.groupBy("block").applyInArrow(_local(axes, rules), _LOCAL), "topk-local")

    # neighbouring blocks share a group of queries
    width = max(1, blocks * rules.query_rows // max(1, asked))
    group = F.expr(f"(block div {width}L)")
    asking = local.where("vec_id is not null").withColumn("g", F.struct(F.shiftright("block", 32).alias("d"), group.alias("k")))
    a = _boxes(asking, "g", "low", "high").join(asking.groupBy("g").agg(F.max("radius").alias("r")), "g").select("g", F.col("low").alias("low_a"), F.col("high").alias("high_a"), "r")
    b = local.where("vec_id is null").select("block", F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    gap = lambda x, y: F.zip_with(x, y, lambda p, q: F.greatest(p - q, F.lit(0.0)))
    apart = F.aggregate(F.concat(gap(F.col("low_a"), F.col("high_b")), gap(F.col("low_b"), F.col("high_a"))), F.lit(0.0), lambda s, v: s + v * v)
    pairs = a.join(b, F.col("g.d") == F.shiftright("block", 32)).where(~(apart > F.col("r") * F.col("r") * 1.00001 + 1e-9)).select("g", F.col("block").alias("b"))
    pairs = materialize(pairs, "topk-pairs")

    left = asking.select("g", F.col("block").alias("home"), "vec_id", "embedding", "radius").join(pairs, "g").groupBy("g", "b")
    data = cut.select("block", F.col("vec_id").alias("id"), F.col("embedding").alias("data"))
    right = data.join(pairs.select(F.col("g").alias("h"), F.col("b").alias("c")), F.col("block") == F.col("c")).groupBy("h", "c")
    across = left.cogroup(right).applyInArrow(_across(axes, rules), _FOUND)
    own = local.select("vec_id", F.explode("near").alias("n")).select("vec_id", "n.id", "n.distance")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "id"))
    return own.unionAll(across).withColumn("rank", rank).where(F.col("rank") <= rules.k).select("vec_id", "rank", F.col("id").alias("neighbor_id"), F.round("distance", 6).alias("distance"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the rows whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), queries="vec_id % 20 = 0")


QUERIES = {"op1_topk_search": op1_topk_search}
SQL = {
    "op1_topk_search": """
    with v as (select vec_id, min(embedding) e from embeddings where vec_id is not null and len(embedding) > 0 group by vec_id),
    p as (select a.vec_id, b.vec_id neighbor_id, list_distance(a.e::double[], b.e::double[]) d from v a join v b on a.vec_id <> b.vec_id and a.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by vec_id order by d, neighbor_id) k from p)
    select vec_id, k::integer as rank, neighbor_id, round(d, 6) as distance from r where k <= 10
    """
}
