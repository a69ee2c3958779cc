"""Bitmaps as arrays of rows of 0 and 1, and colour images as arrays of rows of (red,
green, blue)."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from bitloom.functions.regions import composite  # noqa: F401  (part of this surface)


def new(width: int, height: int, value: int = 0) -> np.ndarray:
    if width < 0 or height < 0:
        raise ValueError("a bitmap of negative size")
    return np.full((height, width), value & 1, np.uint8)


def from_packed(data: bytes, width: int, height: int) -> np.ndarray:
    """Rows of whole bytes, the first pixel highest; bits beyond the width are ignored."""
    stride = width + 7 >> 3
    if len(data) != stride * height:
        raise ValueError("the data has another size than the bitmap")
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(height, stride), axis=1)[:, :width].copy()


def to_packed(bitmap: np.ndarray) -> bytes:
    return np.packbits(bitmap, axis=1).tobytes()


def get(bitmap: np.ndarray, x: int, y: int) -> int:
    """Paper outside."""
    return int(bitmap[y, x]) if 0 <= y < bitmap.shape[0] and 0 <= x < bitmap.shape[1] else 0


def put(bitmap: np.ndarray, x: int, y: int, value: int) -> None:
    if 0 <= y < bitmap.shape[0] and 0 <= x < bitmap.shape[1]:
        bitmap[y, x] = value & 1


def grow_height(bitmap: np.ndarray, height: int, value: int = 0) -> np.ndarray:
    """As high as said, never lower; new rows have ``value``."""
    more = max(0, height - bitmap.shape[0])
    return np.concatenate([bitmap, new(bitmap.shape[1], more, value)])


def copy_rect(source: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """A rectangle, with paper where it leaves the source."""
    out = new(width, height)
    composite(out, source, -x, -y, 4)
    return out


def pixel_hash(bitmap: np.ndarray) -> bytes:
    """128 bits of size and pixels."""
    return blake2b(np.array(bitmap.shape, ">u4").tobytes() + to_packed(bitmap), digest_size=16).digest()


def to_luma(bitmap: np.ndarray) -> np.ndarray:
    """Ink is black."""
    return np.where(bitmap, 0, 255).astype(np.uint8)


def from_luma(luma: np.ndarray, threshold: int = 128) -> np.ndarray:
    return (luma < threshold).astype(np.uint8)


def luma_of(rgb: np.ndarray) -> np.ndarray:
    weights = np.array([299, 587, 114])
    return (rgb.astype(np.int64) @ weights // 1000).astype(np.uint8)


def composite_colour(page: np.ndarray, mask: np.ndarray, x: int, y: int, colour: tuple[int, int, int]) -> None:
    """Paints the mask's ink onto an RGB page, clipped."""
    h, w = mask.shape
    y0, y1, x0, x1 = max(0, y), min(page.shape[0], y + h), max(0, x), min(page.shape[1], x + w)
    if y1 > y0 and x1 > x0:
        page[y0:y1, x0:x1][mask[y0 - y : y1 - y, x0 - x : x1 - x] == 1] = colour


def differing(a: np.ndarray, b: np.ndarray) -> int | None:
    """Differing pixels; None where the sizes differ."""
    return int((a != b).sum()) if a.shape == b.shape else None
