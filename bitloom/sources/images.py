"""Bilevel pages from image files: PBM (P4, one or several in a file) and BMP of 1 or 24
bits a pixel."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bitloom.functions.bitmap import from_luma, from_packed, luma_of, to_packed


def read_pbm(data: bytes) -> list[np.ndarray]:
    """The bitmaps of a file, one after another."""
    out, at = [], 0
    while at < len(data):
        fields: list[bytes] = []
        while len(fields) < 3:
            if data[at : at + 1] == b"#":
                at = data.index(b"\n", at)
            if data[at : at + 1].isspace():
                at += 1
                continue
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            if end == at:
                raise ValueError("the header is cut off")
            fields.append(data[at:end])
            at = end
        if fields[0] != b"P4":
            raise ValueError("not a binary PBM")
        width, height = int(fields[1]), int(fields[2])
        at += 1
        size = (width + 7 >> 3) * height
        out.append(from_packed(data[at : at + size], width, height))
        at += size
    return out


def write_pbm(bitmap: np.ndarray) -> bytes:
    return b"P4\n%d %d\n" % (bitmap.shape[1], bitmap.shape[0]) + to_packed(bitmap)


def read_bmp(data: bytes) -> np.ndarray:
    """Ink where a pixel is dark."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP")
    start, header, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or depth not in (1, 24) or width <= 0:
        raise ValueError("only plain BMPs of 1 or 24 bits")
    rows, stride = abs(height), (width * depth + 31 >> 5) * 4
    raw = np.frombuffer(data[start : start + stride * rows], np.uint8).reshape(rows, stride)
    if depth == 1:
        palette = np.frombuffer(data[14 + header : 14 + header + 8], np.uint8).reshape(2, 4)[:, 2::-1]
        out = from_luma(luma_of(palette))[np.unpackbits(raw, axis=1)[:, :width]]
    else:
        out = from_luma(luma_of(raw[:, : 3 * width].reshape(rows, width, 3)[:, :, ::-1]))
    return out[::-1].copy() if height > 0 else out.copy()


def one_bit(data: bytes) -> bool:
    """Whether a BMP has one bit a pixel, as an oracle file should."""
    return data[:2] == b"BM" and len(data) >= 30 and struct.unpack_from("<H", data, 28)[0] == 1


def read_pages(files: DataFrame) -> DataFrame:
    """(sid, page, width, height, bits, error) of files (path, content)."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    made = [] if data is None else [read_bmp(data)] if data[:2] == b"BM" else read_pbm(data)
                    rows += [(path, k, x.shape[1], x.shape[0], to_packed(x), None) for k, x in enumerate(made, 1)]
                except (ValueError, struct.error) as e:
                    rows.append((path, None, None, None, None, str(e)))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["sid", "page", "width", "height", "bits", "error"])

    return files.select("path", "content").mapInArrow(read, "sid string, page bigint, width bigint, height bigint, bits binary, error string")
