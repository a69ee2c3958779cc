"""Pairs of glyphs by blocks: whatever the blocks' size, every pair once."""

import random
from collections import defaultdict

import pytest

from bitloom.operators import symbols


@pytest.mark.parametrize("block, tile, least", [(3, 4, 4), (7, 1, 2), (1 << 14, 1 << 16, 16)])
def test_blocks_change_nothing(spark, tmp_path, monkeypatch, block, tile, least):
    for name, v in (("BLOCK", block), ("TILE", tile), ("_LEAST_BLOCKS", least)):
        monkeypatch.setattr(symbols, name, v)
    rng = random.Random(3)
    base = [[rng.choice([-1.0, 1.0]) for _ in range(64)] for _ in range(4)]
    ids = [*range(14), 5, 5, 5, 5, 6, None, -3]  # ids that repeat across blocks, and one that is unknown
    rows = [(i, 0, [-x if rng.random() < 0.1 else x for x in rng.choice(base)]) for i in ids] + [(99, 0, [1.0] * 63)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    bits = [(i, sum((x > 0) << k for k, x in enumerate(e))) for i, _, e in rows if len(e) == 64 and i is not None]
    pairs = [(a, b, (x ^ y).bit_count(), min(x.bit_count(), y.bit_count())) for a, x in bits for b, y in bits if a < b]
    per = defaultdict(list)
    for a, _, d, _ in pairs:
        per[a].append(d)

    def run(query):
        return sorted(tuple(r) for r in symbols.TEMPLATES[query].spark(spark, str(tmp_path)).collect())

    assert run("glyph_wxor_distance") == sorted((a, min(d), max(d), len(d)) for a, d in per.items())
    assert run("glyph_xor_pairs") == sorted(p[:3] for p in pairs if p[2] <= 20)
    assert run("lossy_edges") == sorted(p for p in pairs if p[2] * 1000 <= 600 * max(1, p[3]))


def test_no_row_of_the_plan_is_a_pair(spark, tmp_path):
    spark.createDataFrame([(i, 0, [float(i - 3)] * 64) for i in range(9)], "vec_id bigint, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = symbols.TEMPLATES["glyph_wxor_distance"].spark(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" not in plan and "FlatMapGroupsInArrow" in plan
