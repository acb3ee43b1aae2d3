"""Registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package; each has QUERIES (name -> (spark, sf_dir) -> DataFrame) and SQL (name -> text).
MODULES = ("queries_pairs", "queries_text", "queries_chat", "queries_mix", "queries_encoding")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"lorespark.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
