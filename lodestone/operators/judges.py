"""Judges that are passed in: hits put in a new order, texts judged in stages, keywords read from replies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.batches import call_batch
from lodestone.sources.shared import settled


def reranked(hits: DataFrame, pair: Column, scorer: Callable[[list[str]], list[str]] | None, k: int, scale: float = 1.0, size: int = 10) -> DataFrame:
    """(query_id, id, original_rank, new_rank, score): the hits (query_id, id, rank, score) in the order of a scorer's scores.

    ``pair`` is what the scorer sees of a hit; it is called on lists of at most ``size`` and its
    replies are read as numbers, divided by ``scale``. Where no reply of a query can be read, or
    without a scorer, its hits stay in their order with their own scores. Of the first ``k`` of a
    query scores are made to lie between 0 and 1, all 1 where they are equal.
    """
    if scorer is None:
        judged = hits.withColumn("__s", F.lit(None).cast("double"))
    else:
        judged = call_batch(hits.withColumn("__pair", pair), "__pair", scorer, size).withColumn("__s", F.expr("try_cast(trim(reply) AS DOUBLE)") / scale)
    own = W.partitionBy("query_id")
    used = F.when(F.max(F.col("__s").isNotNull()).over(own), F.col("__s")).otherwise(F.col("score"))
    ordered = judged.withColumn("__u", used).withColumn("new_rank", F.row_number().over(own.orderBy(F.desc_nulls_last("__u"), "rank", "id"))).where(F.col("new_rank") <= k)
    filled = ordered.withColumn("__u", F.coalesce("__u", F.min("__u").over(own), F.lit(0.0)))
    low, high = F.min("__u").over(own), F.max("__u").over(own)
    score = F.when(high == low, 1.0).otherwise(F.round((F.col("__u") - low) / (high - low), 6))
    return filled.select("query_id", "id", F.col("rank").alias("original_rank"), "new_rank", score.alias("score"))


def judged(texts: DataFrame, text: str, judges: dict[str, Callable[[list[str]], list[str]]], yes: str = "yes", size: int = 10) -> DataFrame:
    """``texts`` with ``blocked_by`` and ``errors``: the judges are asked in order, each only about what none before has blocked.

    A judge blocks with a reply that begins with ``yes``, case aside. One that fails for a text lets it
    pass and is counted in ``errors``.
    """
    left = settled(texts.withColumn("errors", F.lit(0)))
    done = []
    for name, judge in judges.items():
        asked = settled(call_batch(left, text, judge, size))
        hit = F.coalesce(F.lower(F.trim("reply")).startswith(yes), F.lit(False))
        counted = asked.withColumn("errors", F.col("errors") + F.col("error").isNotNull().cast("int"))
        done.append(counted.where(hit).withColumn("blocked_by", F.lit(name)).select(*texts.columns, "blocked_by", "errors"))
        left = counted.where(~hit).select(*texts.columns, "errors")
    return reduce(DataFrame.union, done, left.withColumn("blocked_by", F.lit(None).cast("string")).select(*texts.columns, "blocked_by", "errors"))


def all_judged(texts: DataFrame, id_col: str, text: str, judges: dict[str, Callable[[list[str]], list[str]]], confidence: float = 0.85, yes: str = "yes") -> DataFrame:
    """(id, categories, confidence): what each judge finds in every text, whatever the others say; null categories where nothing is found.

    Every category that is found counts with ``confidence``; without any it is 0.
    """
    found = []
    for name, judge in judges.items():
        asked = call_batch(texts.select(id_col, text), text, judge)
        found.append(asked.where(F.lower(F.trim("reply")).startswith(yes)).select(id_col, F.lit(name).alias("category")))
    hits = reduce(DataFrame.union, found).groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return texts.select(id_col).join(hits, id_col, "left").select(id_col, "categories", F.when(F.col("categories").isNotNull(), confidence).otherwise(0.0).alias("confidence"))


def query_keywords(asked: DataFrame, query: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """``asked`` with ``local`` and ``global``: keywords read from a model's JSON reply; the query itself and none where it can't be read."""
    read = F.from_json("reply", "local array<string>, global array<string>")
    none = F.array().cast("array<string>")
    got = call_batch(asked, query, model)
    ok = F.size(F.coalesce(read["local"], none)) > 0
    return got.select(*asked.columns, F.when(ok, read["local"]).otherwise(F.array(query)).alias("local"), F.when(ok, F.coalesce(read["global"], none)).otherwise(none).alias("global"))
