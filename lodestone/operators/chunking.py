"""Sentences, greedy packing and fixed windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """Sentences with their terminators, trimmed; empty ones dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?。！？])\s*|(?<=\n)")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def chunk_tokens(text: Column) -> Column:
    """The chunker's count: a quarter of the characters, rounded down, and one."""
    return F.floor(F.length(text) / 4) + 1


def pack(parts: Column, limit: int, cuts: Column | None = None) -> Column:
    """Neighbouring sentences joined by nothing while the sum of their tokens stays within ``limit``.

    A sentence above the limit stands alone. ``cuts`` tells for each sentence whether a new part
    begins before it in any case. Each element holds (text, tokens); tokens are those of the whole.
    """
    empty = F.array().cast("array<string>")
    state = F.struct(empty.alias("out"), empty.alias("own"), F.lit(0).cast("bigint").alias("sum"))
    marked = F.arrays_zip(parts.alias("p"), (F.transform(parts, lambda _: F.lit(False)) if cuts is None else cuts).alias("cut"))

    def step(acc: Column, x: Column) -> Column:
        tokens = chunk_tokens(x["p"])
        full = (F.size(acc["own"]) > 0) & ((acc["sum"] + tokens > limit) | F.coalesce(x["cut"], F.lit(False)))
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(F.array_join(acc["own"], "")))).otherwise(acc["out"]).alias("out"),
            F.when(full, F.array(x["p"])).otherwise(F.concat(acc["own"], F.array(x["p"]))).alias("own"),
            F.when(full, tokens).otherwise(acc["sum"] + tokens).alias("sum"),
        )

    ended = F.aggregate(marked, state, step, lambda acc: F.when(F.size(acc["own"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["own"], "")))).otherwise(acc["out"]))
    return F.transform(ended, lambda t: F.struct(t.alias("text"), chunk_tokens(t).alias("tokens")))


def parents(text: Column, similarity: Column | None = None, least: float = 0.6, limit: int = 512) -> Column:
    """Parts (text, tokens) of at most ``limit`` tokens, also cut before a sentence whose similarity to the one before is below ``least``.

    ``similarity`` is an array beside the sentences of the text, null for the first one.
    """
    found = sentences(text)
    return pack(found, limit, None if similarity is None else F.transform(similarity, lambda x: x < least))


def children(text: Column, limit: int = 128) -> Column:
    """Parts (text, tokens) of a parent's text; the whole where it is within the limit."""
    whole = F.array(F.struct(text.alias("text"), chunk_tokens(text).alias("tokens")))
    return F.when(chunk_tokens(text) <= limit, whole).otherwise(pack(sentences(text), limit))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` code points, each starting ``size - overlap`` after the one before."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / stride).cast("int") - 1))
    return F.transform(starts, lambda i: F.substring(text, i * stride + 1, F.lit(size)))
