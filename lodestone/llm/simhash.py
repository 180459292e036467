"""SimHash near-duplicates by meet-in-the-middle ball hashing (:mod:`lodestone.llm.balls`).

Every distinct fingerprint emits the variants within half the radius; they are dealt by their
leading bits, and the fingerprints that meet at a variant are compared. One that is at most
half the radius (rounded down) from the variant is a hub: it is within the radius of each
other one there, so stars around a hub link all that collide and no list of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import balls
from lodestone.llm.components import components
from lodestone.llm.names import fresh
from lodestone.sources.shared import settled

SHINGLE, SEED = 3, 42
WIDTH, RADIUS = 64, 3
#: Least and most leading bits that fingerprints are dealt by, and the variants of one on average.
LEAST_BITS, MOST_BITS, VARIANTS = 6, 30, 561
#: Fingerprints that are dealt at once.
BLOCK = 1 << 14


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many rows have each bit set; rows of unsigned 64-bit words, bits from the least on."""
    raw = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(len(hashes), -1)
    votes = np.zeros(raw.shape[1] * 8, np.int64)
    for i in range(0, len(raw), 255):  # at most 255 in a sum of bytes
        votes += np.add.reduce(np.unpackbits(raw[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return votes


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of 3-word shingles, repeats included; 0 without words or for null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[SHINGLE - 1 :] or ends[-1:]
    hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, last)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += bit_votes(np.array(hashes[i : i + (1 << 16)], np.uint64)[:, None])
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed long (the same 64 bits)."""
    return _fingerprint(text)


_EMITTED = pa.schema([("bucket", pa.int64()), ("fps", pa.binary())])


def _emit(c: int):
    """Fingerprints → rows (bucket, fingerprints with variants in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), BLOCK):
                fps = every[at : at + BLOCK]
                who, bucket = balls.deal(fps, balls.reach_of(fps, RADIUS), WIDTH, c)
                order = np.argsort(bucket, kind="stable")
                who, bucket = who[order], bucket[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                parts = [fps[x].tobytes() for x in np.split(who, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(parts, pa.binary())], schema=_EMITTED)

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the components of the links a–b: (node, least node), roots left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (jump := new[new] != new).any():
            new[jump] = new[new[jump]]
        new = new[label]
        if (new == label).all():
            return nodes[label != np.arange(len(nodes))], nodes[label[label != np.arange(len(nodes))]]
        label = new


def _collide(c: int):
    """Links among the fingerprints that meet at a variant of one bucket, as stars."""

    def run(table: pa.Table) -> pa.Table:
        fps = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["fps"]])
        left, right = [], []
        for who, how, group in balls.meet(fps, balls.reach_of(fps, RADIUS), WIDTH, c, table["bucket"][0].as_py(), halves=True):
            order = np.lexsort((fps[who], how > RADIUS // 2, group))
            fp, far, group = fps[who[order]], how[order] > RADIUS // 2, group[order]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            at = np.repeat(first, np.diff(np.r_[first, len(group)]))
            linked = ~far[at] & (np.arange(len(fp)) != at)
            hub, member = fp[at[linked]], fp[linked]
            linked = np.bitwise_count(hub ^ member) <= RADIUS
            left.append(hub[linked].view(np.int64)), right.append(member[linked].view(np.int64))
        u, v = _forest(np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def links(fps: DataFrame, column: str = "fp") -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints within 3 bits of each other.

    ``fps`` must hold each fingerprint once. The leading bits follow their number, so a
    bucket's arrays stay bounded at any size.
    """
    c = balls.leading_bits(fps.count() * VARIANTS, LEAST_BITS, MOST_BITS)
    emitted = fps.select(column).mapInArrow(_emit(c), "bucket long, fps binary")
    return emitted.groupBy("bucket").applyInArrow(_collide(c), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, text_hash, fp, component_fp, component_id) per row of ``docs``.

    Fingerprints within 3 bits link; a component is named by the least id in it. Null and
    empty texts have fingerprint 0 and link like others; repeated rows stay repeated. Null
    ids are passed over by the minimum; a component of null ids alone has a null name.
    """
    marked = settled(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
            fingerprint_column(F.col(text_col)).alias("fp"),
        )
    )
    prints = settled(marked.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(prints))
    named = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("component_fp")
    )
    least = named.groupBy("component_fp").agg(F.min("low").alias("component_id"))
    named = named.select("fp", "component_fp").join(least, "component_fp")
    return marked.join(named, "fp").select("id", "text_hash", "fp", "component_fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the least id, then text hash.

    All columns stay. Of rows repeated in id and text that whose columns, written as JSON,
    come first stays; a row with a null id stays only if its whole group has none.
    """
    return least_of(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def least_of(docs: DataFrame, near: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each group of ``near`` (id, text_hash, component_fp)."""
    times = near.groupBy("component_fp", "id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    kept = times.groupBy("component_fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash", "times")).alias("k"))
    own, kept_id, kept_hash, again = (fresh(docs, n) for n in ("__hash", "__kept_id", "__kept_hash", "__times"))
    kept = settled(kept.select(F.col("k.id").alias(kept_id), F.col("k.text_hash").alias(kept_hash), F.col("k.times").alias(again)))
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_hash))
    columns = [f"`{c}`" for c in docs.columns]
    if not kept.where(F.col(again) > 1).take(1):
        return keyed.join(kept, same, "left_semi").select(*columns)
    once = keyed.join(kept.where(F.col(again) == 1), same, "left_semi").select(*columns)
    whole = F.struct(*[F.col(c) for c in columns])
    several = keyed.join(kept.where(F.col(again) > 1), same, "left_semi")
    first = several.groupBy(f"`{id_col}`", own).agg(F.min_by(whole, F.to_json(whole)).alias("r"))
    return once.union(first.select(*[F.col(f"r.{c}") for c in columns]))


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component; see :func:`near_duplicates`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
