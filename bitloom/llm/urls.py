"""URL filter by a Bloom filter cascade.

Level 1 is a Bloom filter of the listed keys; level 2 of those keys of the
universe that level 1 takes for listed; level 3 of the listed keys that level 2
takes for unlisted; and so on until no level errs. Because every key of the
corpus took part, walking the levels gives exact membership for all of them,
without a join against the list.

Keys are split by hash into shards of about ``shard_keys``; each shard's cascade
is built in one task, so no level needs a pass of its own over the data. Probing
never joins nor shuffles: levels travel to the tasks in loads of at most
``broadcast_bytes`` (a shard at least), each load answers the keys of its shards in
one scan, and the scans' answers are put together. A load is 64 MB, which holds the
filters of about 10^8 listed keys, so up to there one scan does.

Keys are compared by 128 hash bits. Defined results: a null URL has a null key
and ``listed`` null; an empty or blank URL has the key '' and is listed if the list
has ''; URLs of any length are keyed whole; repeated rows are answered once each;
list entries outside the universe change nothing; an empty list lists nothing;
``page_id`` may be of any type; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.textops import mix
from bitloom.session import materialize, table


@dataclass(frozen=True)
class CascadeRules:
    shard_keys: int = 500_000
    broadcast_bytes: int = 64 << 20


def url_key(url: Column) -> Column:
    """Host (lower case, without port or leading ``www.``) and path, without
    scheme, fragment, ``utm_`` parameters, ``.html`` and trailing slash."""
    x = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    x = F.regexp_replace(x, "#.*$", "")
    x = F.regexp_replace(x, r"utm_[A-Za-z]+=[^&]*&?", "")
    x = F.regexp_replace(x, r"[?&]+$", "")
    host = F.lower(F.regexp_extract(x, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":[0-9]+$", ""), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_extract(x, "^[^/?]*(.*)$", 1), r"(\.html)?/*$", "")
    return F.concat(host, rest)


def hashed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("h1", F.xxhash64(F.col(key))).withColumn("h2", F.xxhash64(F.lit("cascade"), F.col(key)))


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, k: int) -> np.ndarray:
    a = mix(h1.view(np.uint64) ^ mix(np.full(1, level * 2 + 1, np.uint64)))
    b = mix(h2.view(np.uint64) + np.uint64(level)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(k, dtype=np.uint64)) % np.uint64(bits)


def _member(level: int, bits: int, k: int, data: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    p = _positions(h1, h2, level, bits, k)
    return ((data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(1)


Level = tuple[int, int, bytes]


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[Level]:
    """Levels (bits, hashes, filter) for distinct keys and whether each is listed."""
    levels: list[Level] = []
    keys, others = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(keys):
        # the first level thins out the universe; later ones halve what is left
        rate = min(0.5, max(1e-4, 0.7 * len(keys) / max(1, len(others)))) if not levels else 0.5
        k = max(1, round(-np.log2(rate)))
        bits = int(max(64, np.ceil(len(keys) * 1.4427 * max(1.0, -np.log2(rate)))))
        level = len(levels)
        data = np.zeros((bits + 7) // 8, np.uint8)
        p = _positions(h1[keys], h2[keys], level, bits, k).ravel()
        np.bitwise_or.at(data, (p >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))
        levels.append((bits, k, data.tobytes()))
        wrong = others[_member(level, bits, k, data, h1[others], h2[others])]
        keys, others = wrong, keys
    return levels


def probe_cascade(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the parity of the first level that denies it."""
    out = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for level, (bits, k, data) in enumerate(levels):
        yes = _member(level, bits, k, np.frombuffer(data, np.uint8), h1[left], h2[left])
        out[left[~yes]] = level % 2 == 1
        left = left[yes]
    out[left] = len(levels) % 2 == 1
    return out


def _levels_of(shards: list[int], levels: list[int], bits: list[int], ks: list[int], data: list[bytes]) -> dict[int, list[Level]]:
    out: dict[int, list[Level]] = {}
    for s, _, b, k, d in sorted(zip(shards, levels, bits, ks, data), key=lambda x: x[:2]):
        out.setdefault(s, []).append((b, k, d))
    return out


_LEVELS = "shard bigint, level int, bits bigint, k int, data binary"


def _build_shard(t: pa.Table) -> pa.Table:
    h1, h2, listed = (t.column(c).to_numpy() for c in ("h1", "h2", "listed"))
    levels = build_cascade(h1, h2, listed.astype(bool))
    n = len(levels)
    shard = t.column("shard")[0].as_py() if t.num_rows else 0
    return pa.table({"shard": pa.array([shard] * n, pa.int64()), "level": pa.array(range(n), pa.int32()), "bits": pa.array([x[0] for x in levels], pa.int64()), "k": pa.array([x[1] for x in levels], pa.int32()), "data": pa.array([x[2] for x in levels], pa.binary())})


def cascade(universe: DataFrame, listed: DataFrame, shards: int) -> DataFrame:
    """The levels of every shard, of two tables with a column ``key``."""
    both = universe.select("key", F.lit(0).alias("l"), F.lit(1).alias("u")).unionAll(listed.select("key", F.lit(1).alias("l"), F.lit(0).alias("u")))
    keys = hashed(both.where("key is not null"), "key").groupBy("h1", "h2").agg(F.max("l").alias("listed"), F.max("u").alias("u")).where("u = 1")
    return keys.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInArrow(_build_shard, _LEVELS)


def url_membership(pages: DataFrame, listed: DataFrame, rules: CascadeRules = CascadeRules()) -> DataFrame:
    """page_id, key, listed: whether each page's key is on the list.

    ``listed`` has a column ``key`` made by ``url_key``."""
    keyed = pages.select("page_id", url_key(F.col("url")).alias("key"))
    shards = max(1, round(keyed.count() / rules.shard_keys))
    levels = materialize(cascade(keyed, listed, shards), "cascade")
    sizes = levels.groupBy("shard").agg(F.sum(F.length("data")).alias("n")).orderBy("shard").toLocalIterator()
    probe = hashed(keyed, "key").withColumn("shard", F.pmod("h1", F.lit(shards)))
    kind = keyed.schema["page_id"].dataType.simpleString()
    out = f"page_id {kind}, key string, listed boolean"

    def answers(load: list[int]):
        t = levels.where(F.col("shard").between(load[0], load[-1])).toArrow()
        sent = pages.sparkSession.sparkContext.broadcast(_levels_of(*(t.column(c).to_pylist() for c in ("shard", "level", "bits", "k", "data"))))

        def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                h1, h2, s = (b.column(c).to_numpy() for c in ("h1", "h2", "shard"))
                yes = np.zeros(len(h1), bool)
                for shard in np.unique(s):
                    at = np.flatnonzero(s == shard)
                    yes[at] = probe_cascade(sent.value.get(int(shard), []), h1[at], h2[at])
                null = b.column("key").is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("key"), pa.array(yes, mask=null)], ["page_id", "key", "listed"])

        return scan

    # shards without levels list nothing, so they may go with any load
    loads, size = [[]], 0
    for r in sizes:
        if loads[-1] and size + r.n > rules.broadcast_bytes:
            loads.append([])
            size = 0
        loads[-1].append(r.shard)
        size += r.n
    parts = []
    for k, load in enumerate(loads):
        first = 0 if k == 0 else load[0]
        last = shards if k + 1 == len(loads) else loads[k + 1][0] - 1
        parts.append(probe.where(F.col("shard").between(first, last)).mapInArrow(answers(load or [0]), out))
    return reduce(DataFrame.unionAll, parts)


def flagged_keys(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The list of the query: keys of pages whose label is toxic."""
    bad = labels.where("toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    return pages.join(bad, "page_id", "left_semi").select(url_key(F.col("url")).alias("key"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_membership(pages, flagged_keys(pages, table(spark, sf_dir, "labels")))


QUERIES = {"op6_url_filter": op6_url_filter}
SQL = {
    "op6_url_filter": r"""
    with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', ''), 'utm_[A-Za-z]+=[^&]*&?', '', 'g'), '[?&]+$', '') x from pages),
    k as (select page_id, regexp_replace(regexp_replace(lower(regexp_extract(x, '^([^/?]*)', 1)), ':[0-9]+$', ''), '^www\.', '')
        || regexp_replace(regexp_extract(x, '^[^/?]*(.*)$', 1), '(\.html)?/*$', '') as key from a)
    select page_id, key, key in (select key from k where page_id in (select doc_id from labels where toxic = 1)) as listed from k
    """
}
