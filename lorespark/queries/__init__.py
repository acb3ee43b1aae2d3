"""Registered queries of the core, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package; each has QUERIES (name -> (spark, sf_dir) -> DataFrame) and SQL (name -> text).
MODULES = ("integrity", "reports", "retrieval", "knowledge", "ingest", "maintenance")


def collect() -> tuple[dict, dict]:
    """All queries and all SQL of the core."""
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
