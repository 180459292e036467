"""Registered queries of the subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame

from lodestone.session import ship

#: Operator modules; each has one query named opN_<name> and may have its SQL in ORACLE_SQL.
MODULES = ("urls", "bpe", "warczip", "secrets", "decontam", "simhash", "isomedia", "pii", "langid", "quality", "compaction", "spelling", "tokencount")


def shipped(query: Callable) -> Callable:
    """``query`` with the package sent to the Python workers first."""

    @wraps(query)
    def run(spark, *args) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


def queries() -> dict:
    """name → callable(spark, sf_dir)."""
    found = {}
    for module in (import_module(f"lodestone.llm.{m}") for m in MODULES):
        found |= {k: shipped(f) for k, f in vars(module).items() if k.startswith("op") and k[2:3].isdigit()}
    return found


def oracle_sql() -> dict:
    """name → DuckDB SQL, for the operators that SQL can express."""
    found = {}
    for module in (import_module(f"lodestone.llm.{m}") for m in MODULES):
        found |= getattr(module, "ORACLE_SQL", {})
    return found
