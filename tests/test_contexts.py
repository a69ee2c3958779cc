"""Contexts of many rows at once against pixels one by one."""

import numpy as np
import pytest

from bitloom.functions import mq, regions


@pytest.mark.parametrize("template", range(4))
@pytest.mark.parametrize("width, height", [(1, 1), (24, 30), (200, 9), (3, 400)])
def test_contexts_are_those_of_single_pixels(monkeypatch, template, width, height):
    monkeypatch.setattr(regions, "_BAND", 50, raising=False)
    bitmap = (np.random.default_rng(width).random((height, width)) < 0.3).astype(np.uint8)
    shape = regions.pixels(template)
    ink = lambda y, x: int(bitmap[y, x]) if 0 <= y and 0 <= x < width else 0
    want = [[sum(ink(y + dy, x + dx) << k for k, (dx, dy) in enumerate(shape)) for x in range(width)] for y in range(height)]
    seen = []

    class Encoder(mq.Encoder):
        def bit(self, states, k, d):
            seen.append(k)
            super().bit(states, k, d)

    enc = Encoder()
    regions.encode_generic(enc, bitmap, template)
    assert seen == [k for row in want for k in row]
    assert np.array_equal(regions.decode_generic(mq.Decoder(enc.finish()), width, height, template), bitmap)


def test_a_small_page_takes_few_array_operations(monkeypatch):
    """Rows of a narrow page are not made of an operation a template pixel."""
    bitmap = np.eye(24, dtype=np.uint8)
    enc = mq.Encoder()
    regions.encode_generic(enc, bitmap)
    rows = regions.Rows(24, 24, regions.pixels(0))
    assert rows.windows is not None and regions.Rows(5000, 2, regions.pixels(0)).windows is None
    rows.bitmap[:] = bitmap
    wide = regions.Rows(24, 24, regions.pixels(0), 1)
    wide.bitmap[:] = bitmap
    assert all(np.array_equal(rows.above(y), wide.above(y)[0]) for y in range(24))
