"""Entities of a dictionary: near names, and mentions in texts."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query names or patterns of one pass over the table; more take more passes.
MAX_NAMES = 1000


@F.arrow_udf(T.DoubleType())
def _ratio(queries: pa.Array, names: pa.Array) -> pa.Array:
    return pa.array([SequenceMatcher(None, q.as_py(), n.as_py()).ratio() for q, n in zip(queries, names)], pa.float64())


def _passes(names: list[str]) -> list[list[str]]:
    """The distinct names in lists of at most :data:`MAX_NAMES`; one empty list without any."""
    own = sorted(set(names))
    return [own[i : i + MAX_NAMES] for i in range(0, max(1, len(own)), MAX_NAMES)]


def near_names(entities: DataFrame, queries: list[str], threshold: float = 0.8) -> DataFrame:
    """``entities`` (id, name) by each stated query name that they resemble, with the ratio.

    The ratio is twice the matched characters over all characters, in lower case. Lengths and
    the letters in common bound it from above, so few pairs reach Python. Null names go.
    Distinct names are compared once and joined back.
    """
    return reduce(DataFrame.union, [_near_names(entities, own, threshold) for own in _passes(queries)])


def _near_names(entities: DataFrame, queries: list[str], threshold: float) -> DataFrame:
    asked = entities.sparkSession.createDataFrame([(q, q.lower()) for q in queries], "query string, q string")
    own = entities.where("name IS NOT NULL").select(F.lower("name").alias("n")).distinct()
    most = 2 * F.least(F.length("q"), F.length("n")) >= threshold * (F.length("q") + F.length("n"))
    pairs = own.join(F.broadcast(asked), most)  # names of one pass, at most MAX_NAMES
    left_over = F.expr("length(translate(q, n, '')) + length(translate(n, q, ''))")
    all_chars = F.length("q") + F.length("n")
    pairs = pairs.where((all_chars - left_over) >= threshold * all_chars)
    close = pairs.withColumn("ratio", _ratio("q", "n")).where(F.col("ratio") >= threshold)
    return entities.withColumn("n", F.lower("name")).join(close, "n").select("query", "id", "name", F.round("ratio", 6).alias("ratio"))


def mentions(docs: DataFrame, patterns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pattern, times, first) of each stated pattern in each text, case kept; one scan for each :data:`MAX_NAMES` patterns.

    ``times`` counts occurrences that don't overlap, ``first`` is the place from 1. Empty
    patterns are passed over; null texts hold none.
    """
    return reduce(DataFrame.union, [_mentions(docs, own, id_col, text_col) for own in _passes([p for p in patterns if p])])


def _mentions(docs: DataFrame, own: list[str], id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    held = F.filter(F.array(*[F.lit(p) for p in own]) if own else F.expr("array(CAST(NULL AS STRING))"), lambda p: text.contains(p))
    found = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.explode(held).alias("pattern"))
    times = (F.length("t") - F.length(F.replace("t", "pattern", F.lit("")))) / F.length("pattern")
    return found.select("id", "pattern", times.cast("long").alias("times"), F.position("pattern", "t").cast("long").alias("first"))


def multi_match(entities: DataFrame, queries: list[str], threshold: float = 0.8, k: int = 10) -> DataFrame:
    """(query, id, name, score, rank): equal names count 1, near ones 0.8 times the ratio, and
    names that occur in the query 0.6 for each occurrence; the best ``k``, ties to the least id.

    Only names that match in one way or another leave the scan. Null and empty names go.
    """
    return reduce(DataFrame.union, [_multi_match(entities, own, threshold, k) for own in _passes(queries)])


def _multi_match(entities: DataFrame, queries: list[str], threshold: float, k: int) -> DataFrame:
    asked = F.broadcast(entities.sparkSession.createDataFrame([(q,) for q in queries], "query string"))  # at most MAX_NAMES
    named = entities.where("name <> ''")
    near = near_names(named, queries, threshold).select("query", "id", "name", (F.col("ratio") * 0.8).alias("w"))
    low, q = F.lower("name"), F.lower("query")
    times = (F.length(q) - F.length(F.replace(q, low, F.lit("")))) / F.length(low)
    held = named.join(asked, q.contains(low)).select("query", "id", "name", (times * 0.6 + F.when(q == low, 1.0).otherwise(0.0)).alias("w"))
    scored = near.union(held).groupBy("query", "id", "name").agg(F.round(F.sum("w"), 6).alias("score"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
