"""One declarative text per query, rendered for Spark SQL or for DuckDB.

``{table}`` is a table of the data folder. ``$name`` is a word of the dialect;
``$sorted[expr]`` joins a group's values in ascending order with commas. Preludes
are common table expressions that a query names in ``needs``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from bitloom.session import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_SPARK = {"$idiv": "div", "$explode": "explode", "$len": "size", "$array": "array", "$empty": "cast(array() as array<bigint>)", "$range": "sequence", "$str": "string"}
_DUCK = {"$idiv": "//", "$explode": "unnest", "$len": "len", "$array": "list_value", "$empty": "cast([] as bigint[])", "$range": "generate_series", "$str": "varchar"}


def _render(text: str, words: dict[str, str], sorted_as: str, xor_as: str, shift_as: str) -> str:
    text = re.sub(r"\$shr\[([^,\]]*),([^\]]*)\]", lambda m: shift_as.format(m[1], m[2]), text)
    text = re.sub(r"\$sorted\[([^\]]*)\]", lambda m: sorted_as.replace("%", m[1]), text)
    text = re.sub(r"\$xor\[([^,\]]*),([^\]]*)\]", lambda m: xor_as.format(m[1], m[2]), text)
    return re.sub(r"\$\w+", lambda m: words[m[0]], text)


@dataclass(frozen=True)
class Prelude:
    """A named common table expression; ``build`` replaces it on Spark where an
    Arrow function is the better plan."""

    text: str
    needs: tuple[str, ...] = ()
    build: Callable[[SparkSession, str], DataFrame] | None = None


PRELUDES: dict[str, Prelude] = {}


@dataclass(frozen=True)
class Template:
    text: str
    needs: tuple[str, ...] = field(default=())

    def _chain(self, spark: bool) -> list[str]:
        out: list[str] = []

        def add(name: str) -> None:
            p = PRELUDES[name]
            if not (spark and p.build):
                for x in p.needs:
                    add(x)
            if name not in out:
                out.append(name)

        for name in self.needs:
            add(name)
        return out

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        parts, frames = [], {}
        for name in self._chain(True):
            p = PRELUDES[name]
            if p.build:
                frames[f"built_{name}"] = p.build(spark, sf_dir)
                parts.append(f"{name} as (select * from {{built_{name}}})")
            else:
                parts.append(f"{name} as ({p.text})")
        text = ("with " + ", ".join(parts) + " " if parts else "") + self.text
        text = _render(text, _SPARK, "array_join(transform(sort_array(collect_list(%)), v -> cast(v as string)), ',')", "({0} ^ {1})", "shiftright({0}, {1})")
        frames |= {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
        return spark.sql(text, **frames)

    def duck(self) -> str:
        parts = [f"{n} as ({PRELUDES[n].text})" for n in self._chain(False)]
        text = ("with recursive " + ", ".join(parts) + " " if parts else "") + self.text
        text = _render(text, _DUCK, "string_agg(cast(% as varchar), ',' order by %)", "xor({0}, {1})", "({0} >> {1})")
        return re.sub(r"\{(\w+)\}", r"\1", text)
