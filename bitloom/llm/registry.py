"""Queries and SQL of this subpackage.

All modules are imported here at once: where one can't be, neither can this."""

from __future__ import annotations

from bitloom.llm import bpe, html, packing, quality, simhash, suffix, tokens, topk, toxicity, urls

MODULES = (topk, quality, packing, toxicity, simhash, suffix, urls, bpe, html, tokens)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: f for m in MODULES for k, f in m.SQL.items()}
