"""Raster operators on ink sets and on row bytes."""

from __future__ import annotations

from bitloom.plans.dialect import PRELUDES, Prelude, Template
from bitloom.plans.lifts import HEIGHT, WIDTH

_INK = " + ".join(f"bit_count(r{k})" for k in range(8))


def _composite(rule: str) -> Template:
    """Source pixels come shifted onto the destination; outside the clipped source
    box the destination stays."""
    return Template(f"select page, cast(y as int) as y, cast(x as int) as x from ({rule}) z", ("px", "src", "area"))


PRELUDES["src"] = Prelude("select page + 1 as page, y + 3 as y, x + 2 as x from px where y + 3 < 20 and x + 2 < 16", ("px",))
PRELUDES["area"] = Prelude("select p.page, yy.y, xx.x from (select distinct page from src) p cross join (select $explode($range(3, 19)) as y) yy cross join (select $explode($range(2, 15)) as x) xx", ("src",))
PRELUDES["line"] = Prelude("select page, y, cast(sum(1 << x) as bigint) as bits from px group by page, y", ("px",))

TEMPLATES = {
    "composite_or": _composite("select page, y, x from px union select page, y, x from src"),
    "composite_and": _composite("select p.* from px p left join area a on p.page = a.page and p.y = a.y and p.x = a.x left join src s on p.page = s.page and p.y = s.y and p.x = s.x where a.page is null or s.page is not null"),
    "composite_xor": _composite("select page, y, x from (select page, y, x from px union all select page, y, x from src) u group by page, y, x having count(*) = 1"),
    "composite_xnor": _composite(
        """select p.page, p.y, p.x from px p left join area a on p.page = a.page and p.y = a.y and p.x = a.x where a.page is null
        union all select a.page, a.y, a.x from area a left join px p on p.page = a.page and p.y = a.y and p.x = a.x left join src s on s.page = a.page and s.y = a.y and s.x = a.x where (p.page is null) = (s.page is null)"""
    ),
    "composite_replace": _composite("select p.page, p.y, p.x from px p left join area a on p.page = a.page and p.y = a.y and p.x = a.x where a.page is null union all select page, y, x from src"),
    "copy_rect": Template("select page, y - 5 as y, x - 4 as x from px where y between 5 and 20 and x between 4 and 15", ("px",)),
    "grow_height": Template(f"select page, y, x from px where y < 10 union all select p.page, cast(yy.y as int) as y, cast(xx.x as int) as x from (select distinct page from px) p cross join (select $explode($range(10, 12)) as y) yy cross join (select $explode($range(0, {WIDTH - 1})) as x) xx", ("px",)),
    "row_typical": Template(
        f"""select p.page, cast(yy.y as int) as y, coalesce(l.bits, 0) = coalesce(lag(l.bits) over (partition by p.page order by yy.y), 0) as typical from (select distinct page from px) p
        cross join (select $explode($range(0, {HEIGHT})) as y) yy left join (select page, y, bits from line) l on l.page = p.page and l.y = yy.y""".replace("coalesce(lag(l.bits) over (partition by p.page order by yy.y), 0)", "lag(coalesce(l.bits, 0), 1, 0) over (partition by p.page order by yy.y)"),
        ("line",),
    ),
    # pixels whose nine neighbours agree, all ink (1) or all paper (0); beyond the page is paper
    "uniform_3x3": Template(
        f"""select page, y, x, value from (select g.page, g.y, g.x, case when count(b.x) = 9 then 1 when count(b.x) = 0 then 0 end as value
        from (select page, y, $explode($range(0, {WIDTH - 1})) as x from (select page, $explode($range(0, {HEIGHT - 1})) as y from (select distinct page from px) p) r) g
        left join px b on g.page = b.page and b.y between g.y - 1 and g.y + 1 and b.x between g.x - 1 and g.x + 1 group by g.page, g.y, g.x) u where value is not null""",
        ("px",),
    ),
    "run_lengths": Template("select page, y, cast(min(x) as int) as x, count(*) as run from (select page, y, x, x - row_number() over (partition by page, y order by x) as island from px) i group by page, y, island", ("px",)),
    "page_diff": Template(
        "select page, cast(sum(bit_count($xor[p,q])) as bigint) as diff from (select coalesce(a.page, b.page) as page, coalesce(a.bits, 0) as p, coalesce(b.bits, 0) as q from line a full outer join (select page + 1 as page, y, bits from line) b on a.page = b.page and a.y = b.y) d group by page",
        ("line",),
    ),
    "encode_verdict": Template(
        f"""select page, diff, case when diff = 0 then 'OK' when diff * 100 > {WIDTH * HEIGHT} * 5 then 'BAD' else 'LOSSY' end as verdict from
        (select page, cast(sum(bit_count($xor[bits,bits & 16777212])) as bigint) as diff from line group by page) d""",
        ("line",),
    ),
    "pixel_identity_docs": Template("select min(doc_id) as first_doc_id, count(*) as copies, min(length(text)) as n_chars from {documents} where text is not null group by text having count(*) > 1"),
    "luma_threshold": Template("select p_partkey, (299 * (p_partkey % 256) + 587 * (p_size * 5 % 256) + 114 * (p_partkey * 7 % 256)) $idiv 1000 as luma, (299 * (p_partkey % 256) + 587 * (p_size * 5 % 256) + 114 * (p_partkey * 7 % 256)) $idiv 1000 < 128 as ink from {part}"),
    "gray_code_planes": Template("select p_partkey, p_size as g, $xor[p_size,p_size >> 1] as gray, $xor[p_size,p_size >> 1] & 1 as plane0, ($xor[p_size,p_size >> 1] >> 1) & 1 as plane1, ($xor[p_size,p_size >> 1] >> 2) & 1 as plane2 from {part}"),
    "halftone_grid": Template("select p_partkey, m, (-512 + m * 1024 + p_size * 64) >> 8 as y, (768 + m * 96 - p_size * 1024) >> 8 as x from (select p_partkey, p_size, $explode($range(0, 3)) as m from {part}) g"),
    "pattern_slices": Template("select vec_id, k, " + "case k " + " ".join(f"when {k} then r{k}" for k in range(8)) + " end as bits from (select *, $explode($range(0, 7)) as k from glyph) g", ("glyph",)),
    "glyph_ink": Template(f"select vec_id, cast({_INK} as bigint) as ink from glyph", ("glyph",)),
    # ten neighbours: four to the left, five above and the adaptive pixel at (2, -1)
    "context_histogram_t3": Template(
        "select ctx, bit, count(*) as n from (select (c.bits >> x) & 1 as bit, "
        + " + ".join([f"(case when x >= {k} then (c.bits >> (x - {k})) & 1 else 0 end) * {1 << (k - 1)}" for k in range(1, 5)] + [f"(case when x + {dx} between 0 and {WIDTH - 1} then (coalesce(u.bits, 0) >> (x + {dx})) & 1 else 0 end) * {1 << p}" for p, dx in ((4, 2), (5, 1), (6, 0), (7, -1), (8, -2), (9, -3))])
        + f""" as ctx from (select page, y, bits, $explode($range(0, {WIDTH - 1})) as x from line) c left join line u on u.page = c.page and u.y = c.y - 1) h group by ctx, bit""",
        ("line",),
    ),
}
