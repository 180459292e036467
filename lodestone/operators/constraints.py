"""Typed constraints compiled to column predicates."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicate(df: DataFrame, field: str, op: str, value: Any) -> Column:
    """One constraint; false for a missing field, an unknown operator or a wrong type."""
    false = F.lit(False)
    if field not in df.columns:
        return false
    c, many = F.col(field), isinstance(value, (list, tuple, set))
    text = dict(df.dtypes)[field] == "string"
    if op in ("eq", "ne", "gt", "gte", "lt", "lte"):
        if many or isinstance(value, str) != text:
            return F.lit(op == "ne")
        made = {"eq": c == value, "ne": c != value, "gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op]
    elif op == "in":
        made = c.isin(list(value)) if many else false
    elif op == "nin":
        made = ~c.isin(list(value)) if many else F.lit(True)
    elif op in ("contains", "startswith", "endswith"):
        made = getattr(c, op)(value) if text and isinstance(value, str) else false
    else:
        return false
    return F.coalesce(made, false)


def constrain(df: DataFrame, constraints: list[tuple[str, str, Any]]) -> DataFrame:
    """Rows that satisfy all (field, operator, value); no constraint keeps all rows."""
    return df.where(reduce(Column.__and__, [predicate(df, *c) for c in constraints], F.lit(True)))


def filter_dict(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """``{field: value}`` or ``{field: {op: value}}``."""
    flat = [(f, op, v) for f, want in spec.items() for op, v in (want.items() if isinstance(want, dict) else [("eq", want)])]
    return constrain(df, flat)


def page(df: DataFrame, number: int, size: int, *order: str) -> DataFrame:
    """One page of the ordered rows, with ``total``, ``pages`` and whether more follow."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    kept = df.orderBy(*order).offset((number - 1) * size).limit(size)
    pages = F.ceil(F.col("total") / size).cast("long")
    return kept.crossJoin(F.broadcast(total)).withColumn("pages", pages).withColumn("has_next", F.lit(number) < pages)
