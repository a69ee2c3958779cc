"""Bilevel tables derived from the tables of the data folder.

pixels: a page per user, 24 wide, a row per day, ink where an event happened.
glyphs: an 8x8 bitmap per vector, ink where an entry is positive, as eight row
bytes. segments: a stream per user, a segment per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitloom.operators.components import label_components
from bitloom.plans.dialect import PRELUDES, Prelude
from bitloom.session import table

WIDTH, HEIGHT = 24, 30

PRELUDES["px"] = Prelude("select distinct user_id as page, cast(day(ts) - 1 as int) as y, cast(hour(ts) as int) as x from {events} where user_id is not null and ts is not null")

def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    px = spark.sql(PRELUDES["px"].text, events=events)
    return label_components(px, WIDTH)


PRELUDES["reach"] = Prelude(
    f"""select page, y, x, y * {WIDTH} + x as label from px
    union select p.page, p.y, p.x, r.label from reach r join px p on p.page = r.page and abs(p.y - r.y) <= 1 and abs(p.x - r.x) <= 1""",
    ("px",),
)
PRELUDES["cc"] = Prelude("select page, y, x, cast(min(label) as int) as label from reach group by page, y, x", ("reach",), _components)
PRELUDES["box"] = Prelude(
    "select page, label, min(y) as y0, min(x) as x0, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h, count(*) as area from cc group by page, label", ("cc",)
)
PRELUDES["shape"] = Prelude(
    """select c.page, c.label, b.y0, b.x0, b.w, b.h, b.area, $sorted[(c.y - b.y0) * 64 + c.x - b.x0] as bits
    from cc c join box b on c.page = b.page and c.label = b.label group by c.page, c.label, b.y0, b.x0, b.w, b.h, b.area""",
    ("cc", "box"),
)
#: Symbols in the order in which their first instance is met on the page.
PRELUDES["inst"] = Prelude(
    """select *, dense_rank() over (partition by page order by first_label) - 1 as sym from
    (select *, min(label) over (partition by page, w, h, bits) as first_label from shape) f""",
    ("shape",),
)

def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row bytes by built-in array functions, in one pass."""
    e = table(spark, sf_dir, "embeddings")
    return e.where("size(embedding) = 64").selectExpr("vec_id", "label", *[f"aggregate(slice(embedding, {8 * r + 1}, 8), 0L, (a, v) -> a * 2 + if(v > 0, 1L, 0L)) as r{r}" for r in range(8)])


_ROWS = ", ".join(f"cast(list_sum(list_transform(range(8), lambda i: case when embedding[{8 * r} + i + 1] > 0 then 1 << (7 - i)::int else 0 end)) as bigint) as r{r}" for r in range(8))
PRELUDES["glyph"] = Prelude(f"select vec_id, label, {_ROWS} from {{embeddings}} where len(embedding) = 64", (), _glyphs)

PRELUDES["evt"] = Prelude("select user_id as sid, event_id as e, event_type as et, row_number() over (partition by user_id order by ts, event_id) as ord from {events} where user_id is not null")
PRELUDES["seg0"] = Prelude(
    """select sid, e, cast(ord as bigint) as ord, ord - (case when e % 17 = 0 then 2 else 0 end) as number,
    case when e % 23 = 0 then null when et = 'signup' then 48
      when et = 'view' then (case e % 5 when 0 then 16 when 1 then 0 when 2 then 40 when 3 then 39 else 43 end)
      when et = 'click' then (case e % 6 when 0 then 42 when 1 then 36 when 2 then 4 when 3 then 7 else 6 end)
      when et = 'purchase' then (case e % 5 when 0 then 22 when 1 then 20 when 2 then 23 else 38 end)
      else (case e % 8 when 0 then 52 when 1 then 53 when 2 then 54 when 3 then 62 when 4 then 50 when 5 then 51 else 49 end) end as stype,
    case when et = 'view' and e % 2 = 0 then 0 else 1 + ord $idiv 8 end as page,
    case when e % 6 = 0 then $array(ord - 1 - e % 5, ord + (case when e % 30 = 0 then 1 else -2 end)) when e % 6 = 1 then $array(ord - 1) else $empty end as referred,
    (e % 11) * 4 + (case when e % 13 = 0 then 1 else 0 end) as body_len,
    case when e % 19 = 0 then null else (e % 11) * 4 + (case when e % 13 = 0 then 1 else 0 end) + (case when e % 29 = 0 then 3 else 0 end) end as data_length,
    (e * 37) % 256 as flags8, (e * 40503) % 65536 as flags16, (e * 7) % 4 as rw, (e * 11) % 5 as rh,
    case when e % 41 = 0 then 1000000 + e % 3 else (e * 13) % 9 end as n_new, case when e % 43 = 0 then 999999 + e % 4 else (e * 5) % 7 end as n_exp,
    case when e % 37 = 0 then 9999999 + e % 4 else (e * 3) % 7 end as n_inst, case when e % 9 = 0 then null else (e * 37) % 256 end as pflags,
    case when (e * 40503) % 2 = 1 then (e * 30011) % 65536 end as huff, e % 10 as gw, e % 12 as gh, case when e % 31 = 0 then 'Reserved' when e % 3 = 0 then 'Long' else 'Short' end as form,
    case when e % 27 = 0 then 1 else 0 end as lost from evt""",
    ("evt",),
)
PRELUDES["seg"] = Prelude(
    """select *, cast(13 + sum(hl + body_len) over (partition by sid order by ord) - hl - body_len as bigint) as off from
    (select *, cast(11 + $len(referred) as bigint) as hl, cast($len(referred) + 1 - lost as bigint) as retain from seg0) s""",
    ("seg0",),
)
PRELUDES["ref"] = Prelude("select sid, ord, number, stype, page, off, flags16, $explode(referred) as target from seg", ("seg",))
