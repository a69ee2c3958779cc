"""Vectorised text primitives that run inside Arrow batches.

Hashes are polynomials modulo 2**64 over UTF-8 bytes, kept as prefix sums, so
the hash of any byte range costs O(1) and whole documents are hashed with a few
numpy passes instead of a Python call per word. They select and mix features; where
the identity of a text matters, ``text_key`` or the bytes themselves decide.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) <= n:
        size = max(1 << 17, 2 * n)
        with np.errstate(over="ignore"):
            a = np.full(size, _R, np.uint64)
            b = np.full(size, _RINV, np.uint64)
            a[0] = b[0] = 1
            _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Prefix sums of a byte array; entry i covers the first i bytes."""
    p, _ = _powers(len(b))
    h = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[: len(b)], out=h[1:])
    return h


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [s, e); equal bytes give equal hashes."""
    _, q = _powers(len(h))
    return mix((h[e] - h[s]) * q[s])


def hash_bytes(x: bytes) -> int:
    """The same hash for one string."""
    b = np.frombuffer(x, np.uint8)
    return int(span_hash(prefix_hash(b), np.array([0]), np.array([len(b)]))[0])


class Words:
    """White-space words of a text, joined by single spaces, with byte spans."""

    __slots__ = ("words", "data", "b", "s", "e", "h")

    def __init__(self, text: str | None):
        self.words = text.split() if text else []
        self.data = " ".join(self.words).encode("utf-8", "surrogatepass")
        self.b = np.frombuffer(self.data, np.uint8)
        if self.words:
            gaps = np.flatnonzero(self.b == 32)
            self.s = np.concatenate(([0], gaps + 1))
            self.e = np.concatenate((gaps, [len(self.b)]))
        else:
            self.s = self.e = np.zeros(0, np.int64)
        self.h = prefix_hash(self.b)

    def __len__(self) -> int:
        return len(self.words)

    def hashes(self) -> np.ndarray:
        return span_hash(self.h, self.s, self.e)


def text_key(data: bytes) -> int:
    """64 bits of BLAKE2b, to tell the texts of one ``doc_id`` apart."""
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def integer_id(df: DataFrame, name: str) -> Column:
    """The id as bigint; ids of other than integer type are refused."""
    if not isinstance(df.schema[name].dataType, IntegralType):
        raise TypeError(f"{name} must be an integer, not {df.schema[name].dataType.simpleString()}")
    return F.col(name).cast("bigint").alias(name)


def release() -> None:
    """Returns what this process has freed to the system: Arrow's pool and the C
    allocator keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def releasing(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, after which its worker holds no free memory: a worker outlives its task,
    and what it keeps counts on top of what the next stages need."""

    @functools.wraps(f)
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(it)
        finally:
            release()

    return run


def released(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for a function from the table of a group, or from those of two, to a
    table; Spark tells them by their parameters."""

    def run(*tables: pa.Table) -> pa.Table:
        try:
            return f(*tables)
        finally:
            release()

    one: Callable[..., pa.Table] = lambda t: run(t)
    two: Callable[..., pa.Table] = lambda t, u: run(t, u)
    return one if f.__code__.co_argcount == 1 else two


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = "_" + name
    return name
