"""The glyph queries against all pairs of a small table, whatever the labels."""

from collections import defaultdict

import pytest

from bitloom.plans import catalog

GLYPHS = {1: (0, 0xFFFF_0000_FFFF_0000), 2: (1, 0xFFFF_0000_FFFF_0001), 3: (0, 0x0000_FFFF_0000_FFFF), 4: (2, 0xFFFF_0000_FFFF_00FF), 5: (None, 0), 6: (3, 1)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("glyphs")
    rows = [(i, [1.0 if bits >> (63 - k) & 1 else -1.0 for k in range(64)], label) for i, (label, bits) in GLYPHS.items()]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_glyph_queries_compare_all_pairs(spark, folder):
    pairs = {(a, b): ((x ^ y).bit_count(), min(x.bit_count(), y.bit_count())) for a, (_, x) in GLYPHS.items() for b, (_, y) in GLYPHS.items() if a < b}
    per = defaultdict(list)
    for (a, _), (d, _) in pairs.items():
        per[a].append(d)
    run = lambda name, *cols: sorted(tuple(r[c] for c in cols) for r in catalog.queries()[name](spark, folder).collect())
    assert run("glyph_xor_pairs", "a", "b", "diff") == sorted((a, b, d) for (a, b), (d, _) in pairs.items() if d <= 20)
    assert run("glyph_wxor_distance", "a", "nearest", "farthest", "n") == sorted((a, min(d), max(d), len(d)) for a, d in per.items())
    assert run("lossy_edges", "a", "b", "diff", "least_ink") == sorted((a, b, d, k) for (a, b), (d, k) in pairs.items() if d * 1000 <= 600 * max(1, k))
