"""Graph operators over entity and relation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import settled


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes within ``hops`` undirected steps of the seeds (id), with the least step.

    ``edges`` has (src, dst). Each step joins the frontier alone; frontiers are settled so
    that lineage doesn't double, and so are the edges, which every step reads.
    """
    both = settled(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        reached = frontier.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = settled(reached.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(frontier)
    return seen


def resolve(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (src, dst, type) whose two ends both exist among entities (name, entity_id)."""
    one = entities.select(F.col("name").alias("src"), F.col("entity_id").alias("src_id"))
    two = entities.select(F.col("name").alias("dst"), F.col("entity_id").alias("dst_id"))
    return relations.join(one, "src").join(two, "dst").select("src_id", "dst_id", "type")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) counting either end."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
