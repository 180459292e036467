"""Fusion of ranked lists, score scaling and context budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60


def rrf(ranked: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of (path, query_id, id, rank): sum of weight / (k + rank)."""
    weight = F.coalesce(*[F.when(F.col("path") == p, F.lit(w)) for p, w in weights.items()], F.lit(1.0))
    return ranked.groupBy("query_id", "id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"), F.count(F.lit(1)).alias("paths"))


def min_max(scored: DataFrame, *by: str) -> DataFrame:
    """``scaled``: score between the least (0) and the largest (1) of its group; 1 where all are equal."""
    bounds = scored.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return scored.join(bounds, list(by)).withColumn("scaled", F.round(scaled, 6)).drop("lo", "hi")


def merge_scores(a: DataFrame, b: DataFrame, weight_a: float = 0.4, weight_b: float = 0.6) -> DataFrame:
    """Full outer merge of two (query_id, id, score) lists; a missing score counts as 0."""
    a, b = a.select("query_id", "id", F.col("score").alias("sa")), b.select("query_id", "id", F.col("score").alias("sb"))
    total = F.coalesce("sa", F.lit(0.0)) * weight_a + F.coalesce("sb", F.lit(0.0)) * weight_b
    return a.join(b, ["query_id", "id"], "full").select("query_id", "id", F.round(total, 6).alias("score"))


def budget_prefix(rows: DataFrame, budget: int, by: list[str], order: list, tokens: str = "tokens") -> DataFrame:
    """Rows of each group, in order, while their running token sum stays within ``budget``."""
    run = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("used", F.sum(tokens).over(run)).where(F.col("used") <= budget)
