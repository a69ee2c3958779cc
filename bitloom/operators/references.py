"""Resolution of segment references: equi-joins, fallbacks and scopes."""

from __future__ import annotations

from bitloom.plans.dialect import PRELUDES, Prelude, Template

PRELUDES["unresolved"] = Prelude(
    """select g.sid, g.ord, g.page, g.stype from seg g left join (select distinct r.sid, r.ord from ref r join seg t on t.sid = r.sid and t.number = r.target and t.stype = 0) k
    on k.sid = g.sid and k.ord = g.ord where k.sid is null""",
    ("seg", "ref"),
)

TEMPLATES = {
    "ref_resolve": Template("select r.sid, r.ord, r.target, t.ord as target_ord, t.stype as target_type from ref r join seg t on t.sid = r.sid and t.number = r.target", ("seg", "ref")),
    # fallbacks serve segments none of whose references resolves to a symbol dictionary
    "ref_fallback_all": Template(
        """select g.sid, g.ord, count(*) as n_prior, max(d.ord) as last_prior from unresolved g join seg d on d.sid = g.sid and d.stype = 0 and d.ord < g.ord and (d.page = 0 or d.page = g.page)
        where g.stype = 0 group by g.sid, g.ord""",
        ("seg", "ref", "unresolved"),
    ),
    "ref_fallback_latest": Template(
        """select sid, ord, greatest(coalesce(own, 0), coalesce(shared, 0)) as latest from (select sid, ord, stype, resolved,
        max(case when stype = 0 and page <> 0 then ord end) over (partition by sid, page order by ord rows between unbounded preceding and 1 preceding) as own,
        max(case when stype = 0 and page = 0 then ord end) over (partition by sid order by ord rows between unbounded preceding and 1 preceding) as shared
        from (select s.*, u.ord is null as resolved from seg s left join unresolved u on u.sid = s.sid and u.ord = s.ord) m) w
        where stype in (4, 6, 7) and not resolved and greatest(coalesce(own, 0), coalesce(shared, 0)) > 0""",
        ("seg", "ref", "unresolved"),
    ),
    "scope_filter": Template("select p.sid, p.page, count(*) as n_segments from (select distinct sid, page from seg where page <> 0) p join seg s on s.sid = p.sid and (s.page = p.page or s.page = 0) group by p.sid, p.page", ("seg",)),
    "page_count": Template("select sid, max(page) as num_pages from seg where stype = 48 group by sid", ("seg",)),
    "segment_listing": Template("select sid, ord, number, stype, page, off, hl, body_len from seg", ("seg",)),
}
