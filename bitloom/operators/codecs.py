"""Queries that code and decode whole tables: what comes back is held against SQL that
never saw a codec."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import huffman, mq, regions
from bitloom.functions.pages import EncodeRules
from bitloom.operators.documents import decode_pages, encode_documents
from bitloom.plans.dialect import Template
from bitloom.plans.lifts import HEIGHT, WIDTH
from bitloom.session import spread, table


class Coded(Template):
    """A text for DuckDB and a function for Spark."""

    def __init__(self, text: str, needs: tuple[str, ...], build: Callable[[SparkSession, str], DataFrame]):
        super().__init__(text, needs)
        object.__setattr__(self, "build", build)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir)


def lifted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event pages as packed bitmaps."""
    line = Template("select page, y, bits from line", ("line",)).spark(spark, sf_dir)
    rows = F.array_sort(F.collect_list(F.struct("y", "bits")))
    width = WIDTH + 7 >> 3

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for lines in b.column(1).to_pylist():
                bitmap = np.zeros((HEIGHT, 8 * width), np.uint8)
                for r in lines:
                    bitmap[r["y"], :WIDTH] = [r["bits"] >> x & 1 for x in range(WIDTH)]
                out.append(np.packbits(bitmap, axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["sid", "bits"])

    packed = spread(line, "page").groupBy("page").agg(rows.alias("r")).mapInArrow(pack, "sid bigint, bits binary")
    return packed.selectExpr("sid", "1L as page", f"{WIDTH}L as width", f"{HEIGHT}L as height", "bits")


def _pages(rules: EncodeRules) -> Callable[[SparkSession, str], DataFrame]:
    """The pages encoded, decoded, and their rows as numbers again."""

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sid, y, bits = [], [], []
            for s, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = np.unpackbits(np.frombuffer(data, np.uint8).reshape(HEIGHT, -1), axis=1)[:, :WIDTH].astype(np.int64) @ (1 << np.arange(WIDTH))
                at = np.flatnonzero(rows)
                sid += [s] * len(at)
                y += at.tolist()
                bits += rows[at].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(y, pa.int32()), pa.array(bits, pa.int64())], ["page", "y", "bits"])

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        decoded = decode_pages(encode_documents(lifted_pages(spark, sf_dir), rules))
        return decoded.where("error is null").select("sid", "bits").mapInArrow(unpack, "page bigint, y int, bits bigint")

    return build


def generic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every glyph coded as a generic region, and all of a batch decoded in step."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            ink = (b.column(1).flatten().to_numpy().reshape(-1, 8, 8) > 0).astype(np.uint8)
            streams = []
            for bitmap in ink:
                enc = mq.Encoder()
                regions.encode_generic(enc, bitmap)
                streams.append(enc.finish())
            rows = regions.decode_many(streams, 8, 8).astype(np.int64) @ (1 << np.arange(8)[::-1])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(8))], ["vec_id", *(f"r{k}" for k in range(8))])

    vectors = table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", "embedding")
    return vectors.mapInArrow(run, "vec_id bigint, " + ", ".join(f"r{k} bigint" for k in range(8)))


_VALUE = "case when l_linenumber % 2 = 0 then -cast(l_quantity as bigint) else cast(round(l_extendedprice) as bigint) end"


#: Values of an order up to which it is coded in step with others, and values that are
#: coded at once; they bound memory and change no result.
_IN_STEP, _AT_ONCE = 64, 1 << 14


def _alone(values: list[int]) -> list[int]:
    enc, states = mq.Encoder(), bytearray(512)
    for x in [*values, None]:
        mq.encode_integer(enc, states, x)
    dec, states, back = mq.Decoder(enc.finish()), bytearray(512), []
    while (v := mq.decode_integer(dec, states)) is not None:
        back.append(v)
    return back


def integer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's values coded with the arithmetic integer coder, those of many
    orders in step."""

    def code(b: pa.RecordBatch) -> pa.RecordBatch:
        values = b.column(1).flatten()
        known = values.is_valid().to_numpy(zero_copy_only=False)
        order = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())[known]
        v, size = values.drop_null().to_numpy(), np.bincount(order, minlength=b.num_rows)
        short = size <= _IN_STEP
        back, ends = mq.decode_integers(mq.encode_integers(v[short[order]], np.cumsum(size[short])))
        out = np.full(b.num_rows, None, object)
        texts = pa.array(back).cast(pa.string())
        out[short] = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), texts), ",").to_numpy(zero_copy_only=False)
        stop = np.cumsum(size)
        for k in np.flatnonzero(~short).tolist():
            out[k] = ",".join(map(str, _alone(v[stop[k] - size[k] : stop[k]].tolist())))
        out[size == 0] = None
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["o_orderkey", "decoded"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            held.append(b)
            n += len(b.column(1).flatten())
            if n >= _AT_ONCE:
                yield from map(code, pa.Table.from_batches(held).combine_chunks().to_batches())
                held, n = [], 0
        if held:
            yield from map(code, pa.Table.from_batches(held).combine_chunks().to_batches())

    sql = f"select l_orderkey as o_orderkey, transform(array_sort(collect_list(struct(l_linenumber, {_VALUE} as v))), s -> s.v) as v from {{lineitem}} group by l_orderkey"
    return spark.sql(sql, lineitem=spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), "l_orderkey")).mapInArrow(run, "o_orderkey bigint, decoded string")


def huffman_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of each order through each of the fifteen standard tables."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            known = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            v = b.column(1).fill_null(0).to_numpy()[known]
            for k in range(1, 16):
                table = huffman.standard(k).columns
                back = np.zeros(b.num_rows, np.int64)
                back[known] = table.decode(*table.encode(np.fmod(v, 5) - 2 if k == 14 else v))[0]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, k, np.int32)), pa.array(back, mask=~known)], ["o_orderkey", "table_no", "decoded"])

    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "1 + o_orderkey * o_custkey % 100000 as v").mapInArrow(run, "o_orderkey bigint, table_no int, decoded bigint")


_LINES = "select page, cast(y as integer) as y, bits from line"
TEMPLATES: dict[str, Template] = {
    "generic_roundtrip": Coded("select vec_id, " + ", ".join(f"r{k}" for k in range(8)) + " from glyph", ("glyph",), generic_roundtrip),
    "integer_roundtrip": Coded(f"select l_orderkey as o_orderkey, string_agg(cast({_VALUE} as varchar), ',' order by l_linenumber, {_VALUE}) as decoded from {{lineitem}} group by l_orderkey", (), integer_roundtrip),
    "huffman_roundtrip": Coded("select o_orderkey, k::integer as table_no, case when k = 14 then (1 + o_orderkey * o_custkey % 100000) % 5 - 2 else 1 + o_orderkey * o_custkey % 100000 end as decoded from {orders} cross join (select unnest(range(1, 16)) as k) t", (), huffman_roundtrip),
} | {
    f"page_{name}": Coded(_LINES, ("line",), _pages(rules))
    for name, rules in {
        "generic_t0": EncodeRules("generic", 0),
        "generic_t1": EncodeRules("generic", 1),
        "generic_t2": EncodeRules("generic", 2, False),
        "generic_t3": EncodeRules("generic", 3),
        "mmr": EncodeRules("mmr"),
        "symbol": EncodeRules("symbol"),
        "symbol_huffman": EncodeRules("symbol_huffman"),
        "symbol_refined": EncodeRules("symbol", disagreement=0.4, refine=True),
        "smallest": EncodeRules(),
    }.items()
}
