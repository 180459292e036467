"""State by key that outlives a stream: each micro-batch is folded by Spark and merged into the last saved table.

A version of the table is written for each batch, from the version before it, so that a batch
that runs again after a failure gives the same version. Folding combines before the shuffle, so a
key with a large share of the rows doesn't meet in one task as rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import new_folder, remove


def folded_stream(stream: DataFrame, fold: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], folder: str) -> DataFrame | None:
    """Run ``stream`` to the end of what its source holds; the saved state, or None where nothing has ever come.

    ``fold`` makes states of a batch's rows, ``merge(old, new)`` one state of two. ``folder`` keeps
    the versions and the stream's place, so a later call goes on from there.
    """
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        new, old = fold(batch), saved(spark, folder, before=number)
        (new if old is None else merge(old, new)).write.mode("overwrite").parquet(f"{folder}/states/version={number}")
        if number > 1:
            remove(spark, f"{folder}/states/version={number - 2}")

    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/marks").foreachBatch(save).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return saved(spark, folder)


def saved(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version of the state, of those before a batch if one is named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/states")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    numbers = []
    for entry in files.listStatus(path):
        number = int(entry.getPath().getName().rpartition("=")[2])
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")) and (before is None or number < before):
            numbers.append(number)
    return spark.read.parquet(f"{folder}/states/version={max(numbers)}") if numbers else None


def fold_sessions(events: DataFrame, key: str, order: str, value: str, cleared: Column, keep: int) -> DataFrame:
    """(key, cleared_at, turns, total, created, updated, last): the state of each key after a batch of events.

    Only events after the last one that clears count; a key that nothing follows has 0 turns.
    ``last`` are the places of the last ``keep`` events. Null keys have no session; events come
    in order from batch to batch, in any order within one.
    """
    own = events.where(F.col(key).isNotNull()).select(key, F.col(order).alias("at"), F.col(value).alias("v"), F.coalesce(cleared, F.lit(False)).alias("clear"))
    marks = own.groupBy(key).agg(F.max(F.when(F.col("clear"), F.col("at"))).alias("cleared_at"))
    live = own.join(marks, key).where(~F.col("clear") & (F.col("cleared_at").isNull() | (F.col("at") > F.col("cleared_at"))))
    # The last places by slices of the order first, so that no task holds all events of a key.
    slices = live.groupBy(key, F.pmod(F.xxhash64("at"), F.lit(64)).alias("slice")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum("v").alias("total"), F.min("at").alias("created"), F.max("at").alias("updated"), F.slice(F.sort_array(F.collect_list("at"), False), 1, keep).alias("last")
    )
    last = F.slice(F.sort_array(F.flatten(F.collect_list("last")), False), 1, keep)
    states = slices.groupBy(key).agg(F.sum("turns").alias("turns"), F.sum("total").alias("total"), F.min("created").alias("created"), F.max("updated").alias("updated"), last.alias("last"))
    empty = F.array().cast(states.schema["last"].dataType)
    return marks.join(states, key, "left").select(key, "cleared_at", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("total", F.lit(0.0)).alias("total"), "created", "updated", F.coalesce("last", empty).alias("last"))


def merge_sessions(old: DataFrame, new: DataFrame, key: str, keep: int) -> DataFrame:
    """States after the older and the newer part of a stream; a key that was cleared in the newer part starts anew there."""
    a, b = F.col("a"), F.col("b")
    columns = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*columns).alias("a")).join(new.select(key, F.struct(*columns).alias("b")), key, "full")
    anew = a.isNull() | b["cleared_at"].isNotNull()
    joined = {
        "cleared_at": F.coalesce(b["cleared_at"], a["cleared_at"]),
        "turns": a["turns"] + b["turns"],
        "total": a["total"] + b["total"],
        "created": F.coalesce(a["created"], b["created"]),
        "updated": F.coalesce(b["updated"], a["updated"]),
        "last": F.slice(F.sort_array(F.concat(a["last"], b["last"]), False), 1, keep),
    }
    return both.select(key, *[F.when(b.isNull(), a[c]).when(anew, b[c]).otherwise(joined[c]).alias(c) for c in columns])


def fold_styles(turns: DataFrame, key: str, order: str, text: str, emotions: dict, patterns: dict, words: int = 3, most: int = 20) -> DataFrame:
    """(key, vocabulary, patterns, emotions) of a batch: the first words of each turn in order, each once, and the names of what occurs.

    ``emotions`` and ``patterns`` give for each name the marks of which one must occur. Of a key
    only the first ``most`` words are gathered.
    """
    own = turns.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    each = own.select(key, F.col(order).alias("o"), F.posexplode(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, words)).alias("p", "w"))
    first = each.groupBy(key, "w").agg(F.min(F.struct("o", "p")).alias("at"))
    slices = first.groupBy(key, F.pmod(F.xxhash64("w"), F.lit(64)).alias("slice")).agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "w"))), 1, most).alias("ws"))
    vocabulary = F.transform(F.slice(F.sort_array(F.flatten(F.collect_list("ws"))), 1, most), lambda x: x["w"])
    found = slices.groupBy(key).agg(vocabulary.alias("vocabulary"))

    def names(table: dict) -> Column:
        seen = [F.when(F.bool_or(F.col(text).rlike("|".join(marks))), name) for name, marks in table.items()]
        return F.array_compact(F.array(*seen))

    marks = own.groupBy(key).agg(names(patterns).alias("patterns"), names(emotions).alias("emotions"))
    return marks.join(found, key, "left").select(key, F.coalesce("vocabulary", F.array().cast("array<string>")).alias("vocabulary"), "patterns", "emotions")


def merge_styles(old: DataFrame, new: DataFrame, key: str, most: tuple = (20, 10, 10)) -> DataFrame:
    """Older and newer style as one: what is there stays first, each once, up to ``most`` words, patterns and emotions."""
    fields = ("vocabulary", "patterns", "emotions")
    both = old.join(new.select(key, *[F.col(c).alias(f"n_{c}") for c in fields]), key, "full")
    none = F.array().cast("array<string>")
    return both.select(key, *[F.slice(F.array_distinct(F.concat(F.coalesce(c, none), F.coalesce(f"n_{c}", none))), 1, n).alias(c) for c, n in zip(fields, most)])


def started(spark: SparkSession, purpose: str) -> str:
    """A new folder for a stream's states."""
    return new_folder(spark, purpose)
