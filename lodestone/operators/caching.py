"""Caches and cascades as queries over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ttl_hits(log: DataFrame, keys: list[str], at: str, order: str, seconds: int) -> DataFrame:
    """``log`` with ``hit``: whether the key was used before, at most ``seconds`` ago.

    Every use renews the entry. Windows run within a key and a stretch of time no shorter
    than the limit, so a hot key is spread; only the last use of the stretch before is
    joined to them. A null time never hits and renews nothing.
    """
    span = max(seconds, 3600)
    timed = log.withColumn("__s", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("__b", F.floor(F.col("__s") / (span * 1_000_000)))
    last = timed.where("__s IS NOT NULL").groupBy(*keys, (F.col("__b") + 1).alias("__b")).agg(F.max("__s").alias("__last"))
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    last = last.withColumnsRenamed(names | {"__b": "__next"})
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()]
    joined = timed.join(last, [*same, F.col("__b") == F.col("__next")], "left")
    within = W.partitionBy(*keys, "__b").orderBy("__s", order)
    before = F.coalesce(F.lag("__s").over(within), F.col("__last"))
    hit = F.coalesce(F.col("__s") - before <= seconds * 1_000_000, F.lit(False))
    return joined.withColumn("hit", hit).select(*[f"`{c}`" for c in log.columns], "hit")


def cascade(counts: DataFrame, group: str, tier: str, n: str, wanted: int) -> DataFrame:
    """How many rows each tier gives: a tier is asked only while those before gave too few.

    ``counts`` has one row for each group and tier, so its windows are small.
    """
    before = W.partitionBy(group).orderBy(tier).rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(n).over(before), F.lit(0))
    return counts.withColumn("__seen", seen).where(F.col("__seen") < wanted).select(
        group, tier, n, F.least(F.col(n), F.lit(wanted) - F.col("__seen")).cast("long").alias("taken")
    )


def cache_hits(log: DataFrame, key: str, at: str, order: str, op: str, seconds: int) -> DataFrame:
    """The reads of ``log`` with ``hit``: whether an entry of the key was put in at most ``seconds`` ago and is still there.

    ``op`` is get, set, drop (of the key) or clear (of all keys); reads renew nothing. Only what
    happened within the limit can count, so windows run within a key and a stretch of time, and
    of the stretch before only the last entry and drop of each key are joined to them. Clears are
    gathered by stretch. Rows without a time, key or known op count as nothing.
    """
    micros, span = seconds * 1_000_000, max(seconds, 3600) * 1_000_000
    timed = log.withColumn("__s", F.unix_micros(F.col(at).cast("timestamp"))).where("__s IS NOT NULL").withColumn("__b", F.floor(F.col("__s") / span)).withColumn("__o", F.struct("__s", order))
    own = timed.where(F.col(key).isNotNull() & F.col(op).isin("get", "set", "drop"))
    put, gone = F.when(F.col(op) == "set", F.col("__o")), F.when(F.col(op) == "drop", F.col("__o"))
    before = own.groupBy(F.col(key).alias("__k"), (F.col("__b") + 1).alias("__n")).agg(F.max(put).alias("__put"), F.max(gone).alias("__gone"))
    clears = timed.where(F.col(op) == "clear").select(F.explode(F.array("__b", F.col("__b") + 1)).alias("__c"), "__o").groupBy("__c").agg(F.sort_array(F.collect_set("__o")).alias("__all"))
    up_to = W.partitionBy(key, "__b").orderBy("__s", order).rowsBetween(W.unboundedPreceding, 0)
    here = own.withColumn("__p", F.max(put).over(up_to)).withColumn("__g", F.max(gone).over(up_to)).where(F.col(op) == "get")
    both = here.join(before, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__n")), "left").join(clears, F.col("__b") == F.col("__c"), "left")
    last, drop = F.coalesce("__p", "__put"), F.coalesce("__g", "__gone")
    cleared = F.coalesce(F.exists("__all", lambda c: (c > last) & (c < F.col("__o"))), F.lit(False))
    hit = (F.col("__s") - last["__s"] <= micros) & (drop.isNull() | (drop < last)) & ~cleared
    return both.select(*[f"`{c}`" for c in log.columns], F.coalesce(hit, F.lit(False)).alias("hit"))


def served(requests: DataFrame, snapshots: DataFrame, at: str, seconds: int) -> DataFrame:
    """``requests`` with ``snapshot`` and ``stale``: the last snapshot taken by then, and whether it is older than the limit.

    ``snapshots`` has (taken). A request before the first has null and is stale. Requests and
    snapshots meet by the hour; hours without a snapshot take the last of those before.
    """
    hour = lambda c: F.date_trunc("hour", c)
    taken = snapshots.select("taken").distinct().groupBy(hour(F.col("taken")).alias("__h")).agg(F.sort_array(F.collect_list("taken")).alias("__own"))
    hours = requests.select(hour(F.col(at)).alias("__h")).distinct().join(taken, "__h", "full")
    order = W.orderBy("__h")  # one row an hour
    known = hours.withColumn("__last", F.last(F.try_element_at("__own", F.lit(-1)), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    both = requests.withColumn("__h", hour(F.col(at))).join(known, "__h", "left")
    inside = F.array_max(F.filter("__own", lambda t: t <= F.col(at)))
    used = F.coalesce(inside, F.col("__last"))
    stale = F.coalesce(F.unix_micros(F.col(at)) - F.unix_micros(used) > seconds * 1_000_000, F.lit(True))
    return both.select(*[f"`{c}`" for c in requests.columns], used.alias("snapshot"), stale.alias("stale"))
