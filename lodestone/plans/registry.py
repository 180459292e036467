"""Registered queries of the library and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("lexical", "retrieval", "corpus", "activity", "records", "decisions", "contexts", "stores", "knowledge", "navigable", "users", "graphs", "banks", "feeds", "recall", "judges")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"lodestone.plans.{name}"), what)
    return found


def queries() -> dict:
    """name → callable(spark, sf_dir)."""
    return _all("QUERIES")


def oracle_sql() -> dict:
    """name → SQL, for the queries that SQL can express."""
    return _all("ORACLE")
