"""8-connected components of ink, labelled by their first pixel in raster order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page bigint, y int, x int, label int"


def labels(y: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """Smallest raster index of each pixel's component, by pointer jumping."""
    place = y.astype(np.int64) * width + x
    order = np.argsort(place)
    p, row, col = place[order], y[order], x[order]
    a, b = [], []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        at = np.minimum(np.searchsorted(p, p + dy * width + dx), len(p) - 1)
        hit = (row[at] == row + dy) & (col[at] == col + dx)
        a.append(np.flatnonzero(hit))
        b.append(at[hit])
    i, j = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(p))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(p), np.int64)
    out[order] = p[label]
    return out


def label_components(pixels: DataFrame, width: int) -> DataFrame:
    """(page, y, x, label) of distinct ink pixels; one task holds one page's ink."""

    def page(t: pa.Table) -> pa.Table:
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        return t.select(["page", "y", "x"]).append_column("label", pa.array(labels(y, x, width), pa.int32()))

    return pixels.groupBy("page").applyInArrow(page, SCHEMA)
