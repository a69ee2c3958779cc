"""Code tables as relations: integer buckets, canonical prefixes, run expansion."""

from __future__ import annotations

from bitloom.plans.dialect import PRELUDES, Prelude, Template

PRELUDES["bucket"] = Prelude("select * from (values (0, 0, 3, 2), (1, 4, 19, 4), (2, 20, 83, 6), (3, 84, 339, 8), (4, 340, 4435, 12), (5, 4436, 2147483647, 32)) b(id, low, high, bits)")
PRELUDES["val"] = Prelude("select l_orderkey, l_linenumber, cast(round(l_extendedprice) as bigint) $idiv 7 * (case when l_orderkey % 2 = 0 then 1 else -1 end) as v from {lineitem}")
PRELUDES["hline"] = Prelude("select * from (values (0, 1, 4, 0), (1, 2, 8, 16), (2, 3, 16, 272), (3, 3, 32, 65808)) h(id, prefix_len, range_len, low)")
#: Canonical prefixes: shorter first; the first of a length is twice what the shorter ones used up.
PRELUDES["hcode"] = Prelude("select id, prefix_len, range_len, low, cast((sum(1 << (8 - prefix_len)) over (order by prefix_len, id) - (1 << (8 - prefix_len))) as bigint) >> (8 - prefix_len) as prefix from hline", ("hline",))

TEMPLATES = {
    "ia_bucket": Template("select v.l_orderkey, v.l_linenumber, v.v, b.id as bucket, abs(v.v) - b.low as offset_value, 1 + b.id + b.bits + 1 as n_bits from val v join bucket b on abs(v.v) between b.low and b.high", ("val", "bucket")),
    "sym_code_len": Template("select p_partkey, p_size, n, case when n <= 1 then 0 else length(bin(n - 1)) end as code_len from (select p_partkey, p_size, p_size * (1 + p_partkey % 300) as n from {part}) p"),
    "huff_canonical": Template("select id, prefix_len, prefix from hcode", ("hcode",)),
    "huff_encode_lookup": Template("select l_orderkey, l_linenumber, h.id, h.prefix, abs(v) - h.low as tail from val v join hcode h on abs(v) >= h.low and (h.id = 3 or abs(v) < h.low + (1 << h.range_len))", ("val", "hcode")),
    "t45_expand": Template("select p_partkey, p_size % 7 as colour, k from (select p_partkey, p_size, $explode($range(1, p_size % 9 + 1)) as k from {part}) r"),
    "rate_select": Template("select o_orderkey, mode, bytes from (select *, row_number() over (partition by o_orderkey order by bytes, tie) as k from (select o_orderkey, 'generic' as mode, 0 as tie, o_custkey % 97 as bytes from {orders} union all select o_orderkey, 'symbol', 1, o_orderkey % 89 from {orders}) c) z where k = 1"),
}
