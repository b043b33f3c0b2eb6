"""Registered queries of the core and their SQL; each module has QUERIES and SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("problems", "history", "traversal", "relations", "text", "rules", "policy", "documents", "pipeline")


def collect(package: str, modules: tuple[str, ...]) -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in modules:
        m = import_module(f"{package}.{name}")
        clash = queries.keys() & m.QUERIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql


def core() -> tuple[dict, dict]:
    return collect(__name__, MODULES)
