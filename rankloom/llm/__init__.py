"""Operators for preparing training data.  Nothing outside this subpackage imports it."""

from __future__ import annotations

from importlib import import_module

#: The modules that hold an operator with its query; each has QUERIES and may have SQL.
MODULES = ("secrets", "licenses", "decontaminate", "sstable", "packing", "language", "ngram_join", "warc", "pii", "vector_dedup")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"{__name__}.{m}"), "SQL", {}).items()}
