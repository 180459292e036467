"""Scans over parts in order without a part of the plan that holds them all.

Each part has a digest. Digests of up to 64 neighbours are folded into one, those again, and so
on to the top; then the state before each part is handed down the same tree. A task holds the
digests of one node's children.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import settled

#: Children of a node.
FAN = 64


def _up(fold: Callable):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        digests = [pickle.loads(d.as_py()) for d in table["digest"]]
        whole = digests[0]
        for d in digests[1:]:
            whole = fold(whole, d)
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN], pa.int64()), "digest": pa.array([pickle.dumps(whole)], pa.binary())})

    return run


def _down(step: Callable):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        before = table["before"][0].as_py()
        state, states = None if before is None else pickle.loads(before), []
        for d in table["digest"]:
            states.append(None if state is None else pickle.dumps(state))
            state = step(state, pickle.loads(d.as_py()))
        return pa.table({"part": table["part"].cast(pa.int64()), "before": pa.array(states, pa.binary())})

    return run


def states_before(digests: DataFrame, fold: Callable, step: Callable) -> DataFrame:
    """(part, before) of each part of ``digests`` (part long from 0 on, each once; digest: pickled).

    ``fold(first, second)`` is the digest of two neighbours, ``step(state, digest)`` the state
    after a part; the state before the first is None, written as null. Parts may be missing.
    """
    levels = [settled(digests.select("part", "digest"))]
    most = levels[0].agg(F.max("part")).first()[0]
    if most is None:
        return digests.sparkSession.createDataFrame([], "part long, before binary")
    while most >= FAN:
        node = F.floor(F.col("part") / FAN).alias("node")
        levels.append(settled(levels[-1].groupBy(node).applyInArrow(_up(fold), "part long, digest binary")))
        most //= FAN
    states = None
    for level in reversed(levels):
        parts = level.withColumn("node", F.floor(F.col("part") / FAN))
        if states is None:
            parts = parts.withColumn("before", F.lit(None).cast("binary"))
        else:
            parts = parts.join(states.withColumnRenamed("part", "node"), "node")
        states = parts.groupBy("node").applyInArrow(_down(step), "part long, before binary")
    return settled(states)
