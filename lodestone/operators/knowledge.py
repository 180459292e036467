"""A knowledge graph in tables: lookups of entities, chunks reached from seeds, cut-outs and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.graph import k_hop

TABLES = ("entities", "relations", "chunk_entities", "chunks")


def exact_entities(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, entity_id, popularity) of entities (entity_id, name, synonyms, popularity) whose name or a synonym is the query, case aside."""
    names = entities.select("entity_id", "popularity", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>"))), lambda x: F.lower(x)))).alias("n"))
    return asked.withColumn("n", F.lower("query")).join(names, "n").select("query", "entity_id", "popularity")


def entities_of_type(entities: DataFrame, kind: str, text: Column) -> DataFrame:
    """Entities of one type whose name the text contains or that contain it, the most popular first (``place`` from 1)."""
    low, own = F.lower("name"), F.lower(text)
    hits = entities.where((F.col("type") == kind) & (low.contains(own) | own.contains(low)))
    return hits.withColumn("place", F.row_number().over(W.partitionBy("type").orderBy(F.desc("popularity"), "entity_id")))


def chunks_of_seeds(edges: DataFrame, seeds: DataFrame, links: DataFrame, hops: int, k: int) -> DataFrame:
    """(chunk_id, score, place): chunks by the number of entities within ``hops`` of the seeds; ``links`` has (chunk_id, id)."""
    reached = k_hop(edges, seeds, hops).select("id")
    scored = links.distinct().join(reached, "id").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("score"))
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(k)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")))  # k rows


def chunks_of_keywords(local: DataFrame, relations: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(chunk_id, score, place) from matched entities (id, score) and matched relations (src, dst, score).

    An entity scores its best match; a relation gives its score to both ends, of which the
    better counts. A chunk has the sum over its entities.
    """
    ends = relations.select(F.col("src").alias("id"), "score").union(relations.select("dst", "score"))
    each = local.select("id", "score").union(ends).groupBy("id").agg(F.max("score").alias("score"))
    scored = links.distinct().join(each, "id").groupBy("chunk_id").agg(F.round(F.sum("score"), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(k)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")))  # k rows


def around(entities: DataFrame, relations: DataFrame, kind: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` entities of a type by id, and the relations that touch one of them."""
    kept = entities.where(F.col("type") == kind).orderBy("entity_id").limit(limit)
    ids = kept.select(F.col("entity_id").alias("id"))
    touched = relations.join(ids, F.col("src") == F.col("id"), "left_semi").union(relations.join(ids, F.col("dst") == F.col("id"), "left_semi")).distinct()
    return kept, touched


def cut_out(entities: DataFrame, relations: DataFrame, kind: str | None, nodes: int, edges: int) -> tuple[DataFrame, DataFrame]:
    """The first ``nodes`` entities by place, then those of the type, and the first ``edges`` relations with both ends kept."""
    first = entities.orderBy("place").limit(nodes)
    kept = first if kind is None else first.where(F.col("type") == kind)
    ids = kept.select("entity_id")
    inner = relations.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")
    return kept, inner.select("src", "dst", "type").orderBy("src", "dst", "type").limit(edges)


def merged(own: DataFrame, external: DataFrame, weighted: bool) -> DataFrame:
    """Entities (name, weight) of both: unknown names go in; known ones take the mean of the weights if ``weighted``."""
    both = own.join(external.select("name", F.col("weight").alias("other")), "name", "full")
    known = F.col("weight").isNotNull() & F.col("other").isNotNull()
    weight = F.when(known & F.lit(weighted), (F.col("weight") + F.col("other")) / 2).otherwise(F.coalesce("weight", "other"))
    return both.select("name", F.round(weight, 6).alias("weight"))


def save_graph(path: str, **tables: DataFrame) -> None:
    """Write the graph's tables below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that :func:`save_graph` wrote, by name."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
