"""All registered queries of the bilevel engine, with their SQL."""

from __future__ import annotations

from bitloom.operators import codecs, codes, raster, references, rollups, rules, symbols
from bitloom.plans.dialect import Template

TEMPLATES: dict[str, Template] = {k: v for m in (symbols, raster, rules, references, codes, rollups, codecs) for k, v in m.TEMPLATES.items()}


def queries() -> dict:
    return {k: t.spark for k, t in TEMPLATES.items()}


def oracle_sql() -> dict:
    return {k: t.duck() for k, t in TEMPLATES.items()}
