"""Streams to page bitmaps and back, as DataFrames.

Each stream is decoded, and each document encoded, by itself within an Arrow batch, so
neither needs a shuffle but for gathering a document's pages. A page is (sid, page,
width, height, bits): rows of packed pixels, the first pixel highest, each row filled
up to whole bytes.

Defined results: a null stream has no pages; a page that can't be decoded has what was
drawn before and its ``error``; a stream without pages gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from bitloom.functions import pages as pg
from bitloom.session import spread

PAGE = "page bigint, width bigint, height bigint, bits binary, error string"


def pack(bitmap: np.ndarray) -> bytes:
    return np.packbits(bitmap, axis=1).tobytes()


def unpack(bits: bytes, width: int, height: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(height, width + 7 >> 3), axis=1)[:, :width]


def _schema(kind, fields: str) -> StructType:
    out = StructType().add("sid", kind)
    for f in _parse_datatype_string(fields):
        out.add(f)
    return out


def decode_pages(streams: DataFrame, key: str = "sid", content: str = "content") -> DataFrame:
    """(sid, page, width, height, bits, error): every page of every stream."""
    kind = streams.schema[key].dataType
    arrow = to_arrow_type(kind)

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for sid, data in zip(b.column(0), b.column(1).to_pylist()):
                made = pg.decode_document(data) if data else []
                if made:
                    cols = zip(*[(p.number, p.bitmap.shape[1], p.bitmap.shape[0], pack(p.bitmap), p.error) for p in made])
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([sid.as_py()] * len(made), arrow), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["sid", "page", "width", "height", "bits", "error"])

    return streams.select(key, content).mapInArrow(decode, _schema(kind, PAGE))


def encode_documents(pages: DataFrame, rules: pg.EncodeRules = pg.EncodeRules()) -> DataFrame:
    """(sid, content, modes) of pages (sid, page, width, height, bits), in their order."""
    kind = pages.schema["sid"].dataType
    docs = spread(pages, "sid").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("page", "width", "height", "bits"))).alias("p"))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = [pg.encode_document([unpack(p["bits"], p["width"], p["height"]) for p in doc], rules) for doc in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(to_arrow_type(kind)), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.string()))], ["sid", "content", "modes"])

    return docs.mapInArrow(encode, _schema(kind, "content binary, modes array<string>"))


def compare_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sid, page, verdict): OK, DIFFERENT, SIZE where dimensions differ, or MISSING where
    one side lacks the page; errors count as ERROR."""
    x = a.select("sid", "page", F.struct("width", "height", "bits", "error").alias("x"))
    y = b.select("sid", "page", F.struct("width", "height", "bits", "error").alias("y"))
    verdict = (
        F.when(F.col("x").isNull() | F.col("y").isNull(), "MISSING")
        .when(F.col("x.error").isNotNull() | F.col("y.error").isNotNull(), "ERROR")
        .when((F.col("x.width") != F.col("y.width")) | (F.col("x.height") != F.col("y.height")), "SIZE")
        .when(F.col("x.bits") == F.col("y.bits"), "OK")
        .otherwise("DIFFERENT")
    )
    return x.join(y, ["sid", "page"], "full").select("sid", "page", verdict.alias("verdict"))
