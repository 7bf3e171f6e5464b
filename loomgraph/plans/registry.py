"""All core queries and their SQL."""

from __future__ import annotations

from . import code_queries, doc_queries, problems, search_queries, view_queries

MODULES = [problems, search_queries, code_queries, doc_queries, view_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
