"""Connected components of an edge table, by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Neither nodes nor
edges ever reach the driver; a hot node only meets its rows in joins, which adaptive
execution can split, and in aggregates, which combine before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import settled


def _star(edges: DataFrame) -> DataFrame:
    """One round: every larger neighbour to the least one, then every node's smaller ones."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    large = (
        both.where("v > u")
        .join(least, F.col("u") == F.col("k"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )
    least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    moved = large.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def _in_one(table: pa.Table) -> pa.Table:
    """(node, root) of a few edges, by taking the least root of both ends until nothing changes."""
    nodes, ends = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    x, y = ends[: table.num_rows], ends[table.num_rows :]
    root = np.arange(len(nodes))
    while True:
        low, new = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new][new]
        if (new == root).all():
            return pa.table({"node": pa.array(nodes), "root": pa.array(nodes[root])})
        root = new


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is the least node.

    Self-loops and repeated edges are ignored, null ends have no edge; no edge, no row. Where a
    count finds at most ``few`` different edges, of longs, one task connects them, for many rounds
    over a few rows cost more than they spread; the result is the same.
    """
    edges = settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if few and edges.count() <= few:
        return settled(edges.select("u", "v", F.pmod("u", F.lit(1)).alias("one")).groupBy("one").applyInArrow(_in_one, "node long, root long"))
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        edges = settled(_star(edges))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
