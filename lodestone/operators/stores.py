"""Tables that are kept: inserts with guards, upserts, deletions, unions with precedence, state by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert_absent(kept: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` whose key ``kept`` doesn't have, the first by ``order`` of each key; null keys are left out."""
    first = new.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
    return first.join(kept.select(key).distinct(), key, "left_anti").select(new.columns)


def upsert(kept: DataFrame, new: DataFrame, key: str, created: str = "created", updated: str = "updated") -> DataFrame:
    """``kept`` with the rows of ``new``: a known key takes the new values but keeps its time of creation.

    Keys are unique on either side.
    """
    values = [c for c in kept.columns if c not in (key, created)]
    old = kept.select(key, *[F.col(c).alias(f"__{c}") for c in (*values, created)])
    both = old.join(new.withColumn("__new", F.lit(True)), key, "full")
    chosen = [F.when(F.col("__new"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in values]
    return both.select(key, *chosen, F.coalesce(f"__{created}", created).alias(created)).select(kept.columns)


def by_precedence(stores: list[DataFrame], key: str) -> DataFrame:
    """The stores' rows of one schema, for each key that of the last store that has it; keys are unique in a store."""
    numbered = [s.withColumn("__p", F.lit(i)) for i, s in enumerate(stores)]
    every = reduce(DataFrame.unionByName, numbered)
    best = every.groupBy(key).agg(F.max(F.struct("__p", *[c for c in stores[0].columns if c != key])).alias("r"))
    return best.select(key, *[F.col(f"r.{c}") for c in stores[0].columns if c != key])


def union_until(stores: list[DataFrame], key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of the stores one after another, each key once, with ``place`` from 1.

    Empty and null keys are left out. Only the first ``n`` keys of each store can count, so no
    more are put in order together.
    """
    firsts = []
    for i, store in enumerate(stores):
        one = store.where(F.col(key) != "").groupBy(key).agg(F.min(order).alias(order))
        firsts.append(one.orderBy(order, key).limit(n * (i + 1)).withColumn("__p", F.lit(i)))
    every = reduce(DataFrame.unionByName, firsts).groupBy(key).agg(F.min(F.struct("__p", order)).alias("r"))
    first = every.select(key, F.col("r.__p").alias("store"), F.col(f"r.{order}").alias(order)).orderBy("store", order, key).limit(n)
    return first.withColumn("place", F.row_number().over(W.orderBy("store", order, key)))  # n rows


def keep_last(log: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each log, by ``order``."""
    newest = W.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= n).drop("__n")


def sessions(events: DataFrame, key: str, order: str, cleared: Column, **fields: Column) -> DataFrame:
    """State of each key after all its events: ``fields`` over those after the last that clears it.

    ``fields`` are aggregates. A key whose last event clears it has no state; the event that
    clears belongs to neither side.
    """
    marked = events.withColumn("__clear", F.coalesce(cleared, F.lit(False)))
    last = marked.where("__clear").groupBy(key).agg(F.max(order).alias("__last"))
    live = marked.where("NOT __clear").join(last, key, "left").where(F.col("__last").isNull() | (F.col(order) > F.col("__last")))
    return live.groupBy(key).agg(*[c.alias(n) for n, c in fields.items()])


def lru(log: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """Keys that a cache of that capacity holds after the log: the last used, with their last use and ``place`` from 1."""
    used = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("last")).orderBy(F.desc("last"), key).limit(capacity)
    return used.withColumn("place", F.row_number().over(W.orderBy(F.desc("last"), key)))  # capacity rows
