"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled documents is turned into TF-IDF vectors (classes of three
bytes in a row, hashed words, and how much the text repeats itself) and reduced by a
truncated SVD. The labelled vectors, under 1 MB, are broadcast; each document's cosine
with every one of them is computed exactly, in blocks, and the nearest vote with their
similarity as weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a model is fitted on: the first by hash of doc_id.
MAX_LABELLED = 3000
RANK, NEIGHBOURS, POWER = 48, 25, 8
FOLDS, CUT = 5, 0.3
WORD_BUCKETS = 256

#: Byte classes: space, line ends, lower case, upper case, digits, stops, commas, marks
#: of stress, bars, signs, other ASCII, lead bytes, continuation bytes.
_KINDS = (b" ", b"\t\n\x0b\x0c\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!?", b"|", b"#$%&*+=<>@^~")
_OTHER, _LEAD, _TAIL = len(_KINDS), len(_KINDS) + 1, len(_KINDS) + 2
N_KINDS = len(_KINDS) + 3
_CLASS = np.full(256, _OTHER, np.int32)
_CLASS[0x80:0xC0], _CLASS[0xC0:] = _TAIL, _LEAD
for _i, _chars in enumerate(_KINDS):
    _CLASS[list(_chars)] = _i
TRIPLES = N_KINDS**3
SHARES, STEPS = 4, 10
DIM = TRIPLES + WORD_BUCKETS + SHARES * STEPS


def features(text: str | None) -> np.ndarray:
    """Counts, damped by a logarithm, of one whole text; zeros for empty or null."""
    out = np.zeros(DIM, np.float32)
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    if len(kinds) > 2:
        codes = (kinds[:-2] * N_KINDS + kinds[1:-1]) * N_KINDS + kinds[2:]
        counts = np.bincount(codes, minlength=TRIPLES)
        out[:TRIPLES] = np.log1p(counts * (1000.0 / len(kinds)))
    distinct = set(words)
    hashed = np.bincount(np.fromiter((zlib.crc32(w) for w in distinct), np.int64) % WORD_BUCKETS, minlength=WORD_BUCKETS)
    out[TRIPLES : TRIPLES + WORD_BUCKETS] = np.log1p(hashed * (50.0 / len(distinct)))
    lines = [x for x in raw.replace(b". ", b"\n").split(b"\n") if x]
    repeats = sum(map(bytes.__eq__, words, words[1:])) / len(words)
    shares = (len(distinct) / len(words), repeats, len(set(lines)) / max(1, len(lines)), min(1.0, len(words) / 1000))
    for i, share in enumerate(shares):
        out[TRIPLES + WORD_BUCKETS + i * STEPS + min(STEPS - 1, int(share * STEPS))] = 2.0
    return out


@dataclass
class Model:
    """Projection from weighted features, and the labelled vectors in the reduced space."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def reduce(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors; a row without features stays zero."""
        rows = rows * self.weights
        rows = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)) @ self.projection
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Weighted vote of the nearest labelled vectors; the share of label 1 without any."""
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        cosine = self.reduce(rows) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        least = np.partition(cosine, -k, axis=1)[:, -k][:, None]
        weight = np.where(cosine >= least, np.maximum(cosine, 0.0), 0.0) ** POWER  # ties at the last place all vote
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, weight @ self.labels / np.maximum(total, 1e-9), self.prior)


def fit_rows(rows: np.ndarray, labels: np.ndarray) -> Model:
    """TF-IDF weights and a truncated SVD by subspace iteration, started from fixed numbers."""
    n = len(rows)
    if not n:
        return Model(np.ones(DIM, np.float32), np.zeros((DIM, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float32))
    weights = (np.log((1 + n) / (1 + (rows > 0).sum(axis=0))) + 0.3).astype(np.float32)
    scaled = rows * weights
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-9)
    rank = min(RANK, n, DIM)
    basis = np.random.default_rng(7).standard_normal((DIM, rank)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(scaled.T @ (scaled @ basis))
    model = Model(weights, basis, np.zeros((0, rank), np.float32), labels.astype(np.float32))
    model.vectors = model.reduce(rows).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, label_col: str = "quality") -> Model:
    """A model from the labelled rows of ``docs`` (doc_id, text), at most ``limit`` of them.

    Rows are taken by hash of doc_id. Null ids, texts or labels teach nothing; an id with
    several labels counts with the least, one with several texts with that of the least feature bytes.
    Labels may be of any numeric type.
    """
    known = labels.where(f"doc_id IS NOT NULL AND {label_col} IS NOT NULL").groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y"))
    present = known.join(docs.where("text IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ys, ids = (batch.column(i) for i in range(3))
            made = [features(t.as_py()).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([ids, ys, pa.array(made, pa.binary())], ["doc_id", "y", "f"])

    picked = docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", "y", "doc_id")  # at most `limit` rows
    rows = picked.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, f binary")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("f").alias("f")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    matrix = np.frombuffer(b"".join(r.f for r in rows), np.float32).reshape(-1, DIM)
    return fit_rows(matrix, np.array([r.y for r in rows], np.float32))


def score_documents(docs: DataFrame, model: Model, block: int = 256, out: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``out`` between 0 and 1, in place of one of that name; null and empty texts get the
    share of label 1 among the labelled."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), block):
            rows = np.stack([features(t.as_py()) for t in texts[at : at + block]])
            parts.append(held.value.score(rows))
        scores = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
        return pa.array(np.round(np.clip(scores, 0, 1), 6))

    return docs.withColumn(out, score("text"))


def held_out(folds: int = FOLDS, left: int = 0):
    """Whether crc32 of the id as text leaves ``left``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == left, F.lit(False))


def fit_tables(spark, sf_dir: str) -> Model:
    """The model of the registered query: labelled documents outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return fit(docs.where(~held_out()), labels.where(~held_out()))


def op10_quality_neighbours(spark, sf_dir: str) -> DataFrame:
    """Score of every document; learnt only outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_documents(docs, fit_tables(spark, sf_dir))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= CUT).cast("int").alias("predicted"),
    )
