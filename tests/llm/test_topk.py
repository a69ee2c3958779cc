"""Top-k search against all pairs, over several blocks and groups."""

import numpy as np
import pytest

from bitloom.llm import topk

KIND = "vec_id bigint, embedding array<double>, block int, place string, radius int, d int, near int, query int, g int, rank int, home int, id int, low int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [float(v) for v in e], 1, "x", *range(9)) for i, e in rows], KIND)


def plain(rows, k, asked):
    vectors: dict = {}
    for i, e in rows:
        if i is not None and e is not None and len(e) and np.isfinite(np.array(e, float)).all():
            vectors[i] = min(vectors.get(i, tuple(e)), tuple(e))
    out = set()
    for i, e in vectors.items():
        if asked(i):
            near = sorted((np.sqrt(((np.array(e, float) - np.array(f, float)) ** 2).sum()), j) for j, f in vectors.items() if j != i and len(f) == len(e))
            out |= {(i, r + 1, j, round(d, 6)) for r, (d, j) in enumerate(near[:k])}
    return out


def found(df):
    return {(r.vec_id, r.rank, r.neighbor_id, r.distance) for r in df.collect()}


@pytest.mark.parametrize("rules", [topk.TopKRules(k=3, block_rows=7, query_rows=5), topk.TopKRules(k=4, block_rows=40, query_rows=300, window=4)])
def test_against_all_pairs(spark, rules):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 12)) * 8
    rows = [(k, (centres[k % 5] + rng.normal(size=12)).round(3).tolist()) for k in range(150)]
    rows += [(200 + k, [1.0, 2.0] + [0.0] * 10) for k in range(9)]  # ties across blocks
    rows += [(300 + k, rng.normal(size=3).tolist()) for k in range(11)]
    rows += [(1, [0.0] * 12), (None, [0.0] * 12), (400, None), (401, []), (402, [float("nan")] * 12), (403, [1e300] * 12), (404, [-1e300] * 12), (405, [7.0])]
    df = frame(spark, rows)
    assert found(topk.nearest(df, rules)) == plain(rows, rules.k, lambda i: True)
    assert found(topk.nearest(df, rules, "vec_id % 20 = 0")) == plain(rows, rules.k, lambda i: i % 20 == 0)
    assert topk.nearest(df, rules, "false").count() == topk.nearest(df.limit(0), rules).count() == 0


def test_doubles_are_not_rounded(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0 + 1e-12, 0.0]), (2, [1.0 + 2e-12, 0.0]), (3, [1.0 + 3e-12, 0.0])]
    got = topk.nearest(frame(spark, rows), topk.TopKRules(k=2), "vec_id = 0").collect()
    assert [r.neighbor_id for r in sorted(got, key=lambda r: r.rank)] == [1, 2]


def test_levels_discard_most_pairs_of_clustered_vectors():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    spread = np.zeros((200, 64))
    spread[:, :6] = rng.normal(size=(200, 6)) * 6
    x = (spread[rng.integers(0, 200, 6000)] + rng.normal(size=(6000, 64)) * 0.3) @ turn
    rules = topk.TopKRules()
    axes = topk.principal_axes(list(x[:2000]))
    side = topk.Side.of(np.arange(6000), x, axes, rules)
    q = side.only(np.arange(0, 6000, 20))
    exact = np.sqrt(((q.x[:, None] - x[None]) ** 2).sum(2))
    radius = np.sort(exact, 1)[:, rules.k]
    compared: list[int] = []
    topk.search(q, side, radius, rules, compared)
    assert compared[0] == 300 * 6000
    assert compared[1] < 0.2 * compared[0] and compared[2] < 0.05 * compared[0] and compared[-1] < 0.02 * compared[0]
