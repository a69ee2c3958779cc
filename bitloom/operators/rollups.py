"""Roll-ups of conformance outcomes, sweeps and generators."""

from __future__ import annotations

from bitloom.plans.dialect import PRELUDES, Prelude, Template

PRELUDES["outcome"] = Prelude("select event_id, event_type as impl, user_id as fixture, case cast(floor(value) as bigint) % 6 when 0 then 'Ok' when 1 then 'RejectErr' when 2 then 'RejectOk' when 3 then 'Crash' when 4 then 'Timeout' else 'Unknown' end as verdict from {events} where user_id is not null and value is not null")
_VERDICTS = ("Ok", "RejectErr", "RejectOk", "Crash", "Timeout", "Unknown")
_COUNTS = ", ".join(f"count(case when verdict = '{v}' then 1 end) as n_{v.lower()}" for v in _VERDICTS)
PRELUDES["known"] = Prelude("select * from (values ('click', 1), ('view', 2), ('*', 3)) k(impl, fixture_mod)")
PRELUDES["anchor"] = Prelude("select c_mktsegment as kind, c_nationkey as path, cast(floor(c_acctbal / 5000) as bigint) as expected from {customer}")

TEMPLATES = {
    "decoder_rollup": Template(f"select impl, count(*) as total, {_COUNTS} from outcome group by impl", ("outcome",)),
    "signature_top20": Template("select signature, n from (select *, row_number() over (order by n desc, signature) as k from (select concat(impl, '/', verdict, '/', cast(fixture % 10 as $str)) as signature, count(*) as n from outcome group by 1) s) z where k <= 20", ("outcome",)),
    "cell_classify": Template(
        """select o.event_id, case when k.impl is not null and o.verdict = 'Ok' then 'resolved' when k.impl is not null then 'ki' when o.verdict = 'Ok' then 'ok' when o.verdict in ('Crash', 'Timeout') then 'err' else 'brkn' end as cell
        from outcome o left join known k on (k.impl = o.impl or k.impl = '*') and o.fixture % 7 = k.fixture_mod""",
        ("outcome", "known"),
    ),
    "matrix_stats": Template(f"select fixture % 10 as col, impl, {_COUNTS} from outcome group by fixture % 10, impl", ("outcome",)),
    "strict_mismatch": Template("select fixture, count(*) as n from outcome where verdict in ('Crash', 'Timeout') group by fixture having count(*) > 2", ("outcome",)),
    "catalog_antijoin": Template("select distinct k.impl from known k left join outcome o on o.impl = k.impl where o.impl is null", ("known", "outcome")),
    "anchor_conflicts": Template("select kind, path, count(distinct expected) as n from anchor group by kind, path having count(distinct expected) > 1", ("anchor",)),
    "bitflip_sweep": Template("select p_partkey, k, $xor[p_size,1 << k] as flipped from (select p_partkey, p_size, cast(j as int) as k from (select p_partkey, p_size, $explode($range(0, 7)) as j from {part}) r) s"),
    "budget_cut": Template("select event_id, impl from (select event_id, impl, sum(event_id % 7 + 1) over (partition by impl order by event_id) as spent from outcome) b where spent <= 600", ("outcome",)),
}
