"""Session state: last turns, archives and eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` turns of each session with ``recency`` 1 for the newest."""
    newest = W.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def archive(turns: DataFrame, keep: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """All but the last ``keep`` turns of each session, summed up."""
    last = turns.groupBy(session).agg(F.max(order).alias("last"))
    old = turns.join(last, session).where(F.col(order) <= F.col("last") - keep)
    return old.groupBy(session).agg(
        F.count(F.lit(1)).alias("turns"), F.min(order).alias("first_turn"), F.max(order).alias("last_turn"),
        F.countDistinct("role").alias("roles"), F.sum(F.length("text")).alias("chars"),
    )
