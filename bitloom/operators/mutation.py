"""Damaged variants of streams, made inside the engine: a byte of a binary column is
replaced by slicing, so no mutant passes through Python.

Every result is (sid, case_id, mutation, content); null and empty streams have none.
``buckets`` sorts mutants by what is found first in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bitloom.operators.validation import validate
from bitloom.sources.streams import segments


def with_bytes(content: Column, at: Column, hexed: Column, n: int = 1) -> Column:
    """``content`` with n bytes from ``at`` on replaced."""
    one = F.lit(1)
    head, tail = F.substr(content, F.lit(1), at), F.substr(content, at + n + one, F.length(content))
    return F.concat(head, F.unhex(hexed), tail)


def byte_at(content: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substr(content, at + F.lit(1), F.lit(1))), 16, 10).cast("int")


def _hexed(v: Column, digits: int = 2) -> Column:
    return F.lpad(F.hex(v.cast("bigint")), digits, "0")


def _cases(streams: DataFrame, count: Column) -> DataFrame:
    some = streams.select("sid", "content").where(F.length("content") > 0)
    return some.select("sid", "content", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("case_id"))


def bit_flip_sweep(streams: DataFrame) -> DataFrame:
    """Every bit of every stream, flipped alone."""
    at, bit = F.expr("cast(case_id div 8 as int)"), F.expr("cast(case_id % 8 as int)")
    flipped = byte_at(F.col("content"), at).bitwiseXOR(F.expr("shiftleft(1, cast(case_id % 8 as int))"))
    cases = _cases(streams, F.length("content").cast("bigint") * 8)
    return cases.select("sid", "case_id", F.format_string("bit-flip byte=%d bit=%d", at, bit).alias("mutation"), with_bytes(F.col("content"), at, _hexed(flipped)).alias("content"))


def _draw(seed: int, salt: str, bound: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "sid", "case_id"), bound.cast("bigint")).cast("int")


def sampled_bit_flips(streams: DataFrame, count: int = 64, seed: int = 0x42) -> DataFrame:
    cases = _cases(streams, F.lit(count).cast("bigint")).withColumn("at", _draw(seed, "byte", F.length("content"))).withColumn("bit", _draw(seed, "bit", F.lit(8)))
    flipped = byte_at(F.col("content"), F.col("at")).bitwiseXOR(F.expr("shiftleft(1, bit)"))
    return cases.select("sid", "case_id", F.format_string("bit-flip byte=%d bit=%d", "at", "bit").alias("mutation"), with_bytes(F.col("content"), F.col("at"), _hexed(flipped)).alias("content"))


def sampled_byte_replacements(streams: DataFrame, count: int = 64, seed: int = 0x42) -> DataFrame:
    """A byte becomes another one, never itself."""
    cases = _cases(streams, F.lit(count).cast("bigint")).withColumn("at", _draw(seed, "byte", F.length("content"))).withColumn("drawn", _draw(seed, "value", F.lit(256)))
    old = byte_at(F.col("content"), F.col("at"))
    cases = cases.withColumn("value", F.when(F.col("drawn") == old, (F.col("drawn") + 1) % 256).otherwise(F.col("drawn")))
    return cases.select("sid", "case_id", F.format_string("byte-replace byte=%d value=%d", "at", "value").alias("mutation"), with_bytes(F.col("content"), F.col("at"), _hexed(F.col("value"))).alias("content"))


def length_perturbations(streams: DataFrame, parsed: DataFrame, seed: int = 0x42) -> DataFrame:
    """Each segment's data length a little longer and a little shorter."""
    places = segments(parsed).select("sid", "ord", (F.col("off") + F.col("hl") - 4).cast("int").alias("at"), F.coalesce("data_length", F.lit(0xFFFFFFFF)).alias("old"))
    both = places.join(streams.select("sid", "content"), "sid").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("down"))
    both = both.withColumn("case_id", F.col("ord") * 2 + F.col("down"))
    step = 1 + _draw(seed, "step", F.lit(16))
    both = both.withColumn("delta", F.when(F.col("down") == 1, -step).otherwise(step))
    new = F.pmod(F.col("old") + F.col("delta"), F.lit(1 << 32))
    return both.select("sid", "case_id", F.format_string("length-perturb offset=%d delta=%d", "at", "delta").alias("mutation"), with_bytes(F.col("content"), F.col("at"), _hexed(new, 8), 4).alias("content"))


def buckets(mutants: DataFrame, keep: int = 3, lens: str = "strict") -> DataFrame:
    """(severity, check_id, segment_type, sid, case_id, k, total): mutants by their
    first finding, errors before warnings; ``keep`` examples of each kind."""
    named = mutants.select(F.struct("sid", "case_id").alias("case"), "content")
    found = validate(named, lens, key="case")
    first = F.min(F.struct(F.when(F.col("severity") == "Error", 0).otherwise(1).alias("s"), "byte_offset", "check_id", "severity", "segment_type"))
    primary = found.groupBy("sid").agg(first.alias("f")).select(F.col("sid.sid").alias("sid"), F.col("sid.case_id").alias("case_id"), "f.severity", "f.check_id", "f.segment_type")
    key = ("severity", "check_id", "segment_type")
    totals = primary.groupBy(*key).agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("sid", "case_id"))
    few = primary.withColumn("k", rank).where(F.col("k") <= keep)
    same = [few[c].eqNullSafe(totals[c]) for c in key]
    return few.join(totals, same[0] & same[1] & same[2]).select(*[few[c] for c in key], "sid", "case_id", "k", "total")
