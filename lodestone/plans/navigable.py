"""The navigable graph over ``embeddings``: levels, what it finds against an exact search, and its shape after a reload."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import navigable, vectors
from lodestone.session import ship
from lodestone.sources.tables import table

K = 10


def _graph(s, d):
    ship(s)
    return navigable.kept(navigable.build(table(s, d, "embeddings")))


def graph_levels(s, d):
    """Level of every vector."""
    return table(s, d, "embeddings").select("vec_id", navigable.level_of("vec_id").alias("level"))


def graph_stats(s, d):
    """Vectors of each level, and whether the saved graph keeps to the numbers of links."""
    most = F.when(F.col("level") == 0, 2 * navigable.LINKS).otherwise(navigable.LINKS)
    return navigable.stats(_graph(s, d)).select("level", "nodes", (F.coalesce("most", F.lit(0)) <= most).alias("within"))


def graph_recall(s, d):
    """Whether at least 0.95 of the exact ten nearest of every twentieth vector are found."""
    every = table(s, d, "embeddings")
    asked = every.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    found = navigable.search(_graph(s, d), asked, K)
    exact = vectors.top_k(vectors.score_queries(every.select("vec_id", "embedding"), asked, k=K), K, "query_id")
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg((F.count("hit") >= 0.95 * F.count(F.lit(1))).alias("recall_ok"))


QUERIES = {f.__name__: f for f in (graph_levels, graph_stats, graph_recall)}
_L = "length(regexp_extract(md5(vec_id::VARCHAR), '^0*'))"
ORACLE = {
    "graph_levels": f"SELECT vec_id, {_L}::INTEGER AS level FROM embeddings",
    "graph_stats": f"SELECT {_L}::INTEGER AS level, count(*) AS nodes, true AS within FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1",
    "graph_recall": "SELECT true AS recall_ok",
}
