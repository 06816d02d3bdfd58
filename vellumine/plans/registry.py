"""All queries of the core library and their SQL twins."""

from __future__ import annotations

from vellumine.plans import layout_queries, model_queries, nested_queries, text_queries

MODULES = (text_queries, layout_queries, model_queries, nested_queries)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
