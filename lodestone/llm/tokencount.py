"""Token counts by a sentencepiece BPE model; huge texts in overlapping chunks that are spliced.

A list of symbols is the encoding of its text if each two neighbours are the encoding of theirs:
merges are made by rank and then from left to right, so the first merge across a boundary would
show in the two neighbours alone. In the encoding of a chunk all neighbours are so. Where two
chunks that overlap both have a symbol, at the same place, one chunk's symbols up to it and the
other's after it are therefore the encoding of both together: a proven boundary. A text with an
overlap that holds none is dealt anew with overlaps twice as wide, in the end as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.names import fresh
from lodestone.sources.shared import settled

#: Code points of a chunk and of the overlap on either side of a boundary; longer texts than two chunks are cut.
CHUNK, OVERLAP = 32_768, 512
#: Tokens of a text beyond which the query calls it over its limit.
LIMIT = 4096


@lru_cache(maxsize=2)
def _processor(model: bytes) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    """The library's processor, and how many code points each id stands for.

    A byte piece stands for one where its byte can begin a character, else for none.
    """
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    points = np.array([len(own.id_to_piece(i)) for i in range(own.get_piece_size())], np.int32)
    for i in (i for i in range(len(points)) if own.is_byte(i)):
        points[i] = not 0x80 <= int(own.id_to_piece(i)[3:5], 16) < 0xC0
    return own, points


def symbols(model: bytes, text: str, start: int) -> tuple[int, np.ndarray]:
    """Tokens of a chunk, and its symbols as rows (first code point, last + 1, id, tokens up to its end).

    Places count from the whole text's beginning, ``start`` being the chunk's; the blank that the
    library puts first lies before it. No rows where the symbols don't add up to the text, as
    with a model that changes texts before encoding.
    """
    own, points = _processor(model)
    ids = np.array(own.encode(text, num_threads=1), np.int64)
    lead = np.flatnonzero(points[ids] > 0) if len(ids) else np.zeros(0, np.int64)
    ends = np.cumsum(points[ids[lead]], dtype=np.int64) + start - 1
    if not len(lead) or ends[-1] != start + len(text):
        return len(ids), np.zeros((0, 4), np.int64)
    return len(ids), np.stack([np.r_[start - 1, ends[:-1]], ends, ids[lead], np.r_[lead[1:], len(ids)]], axis=1)


def splice(left: np.ndarray, right: np.ndarray, boundary: int) -> tuple[int, int] | None:
    """(tokens of the left chunk up to a symbol of both, tokens of the right one up to it): the symbol nearest to the boundary.

    None where the chunks have no symbol in common.
    """
    if not len(left) or not len(right):
        return None
    _, i, j = np.intersect1d(left[:, 1], right[:, 1], assume_unique=True, return_indices=True)
    same = (left[i][:, [0, 2]] == right[j][:, [0, 2]]).all(axis=1)
    if not same.any():
        return None
    i, j = i[same], j[same]
    best = np.argmin(np.abs(left[i, 1] - boundary))
    return int(left[i[best], 3]), int(right[j[best], 3])


_CUT = "key string, no long, last boolean, start long, low long, high long, reach long, chunk string"


def _cut(size: int, overlap: int):
    """(key, text) → chunks of the texts, each with its own part [low, high) and ``overlap`` more on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text, key = text.as_py(), key.as_py()
                count = max(1, -(-len(text) // size))
                for no in range(count):
                    low, high = no * size, min((no + 1) * size, len(text))
                    start = max(0, low - overlap)
                    row = [key, no, no == count - 1, start, low, high, overlap, text[start : high + overlap]]
                    kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["key", "no", "last", "start", "low", "high", "reach", "chunk"])

    return run


_ENCODED = "key string, no long, last boolean, boundary long, n long, head binary, tail binary"


def _encode(held):
    """Chunks → tokens and, of the symbols, those in the overlaps at either end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n, own = symbols(held.value, r["chunk"], r["start"])
                head, tail = (own[(own[:, 1] > at - r["reach"]) & (own[:, 1] <= at + r["reach"])] for at in (r["low"], r["high"]))
                rows.append((r["key"], r["no"], r["last"], r["high"], n, head.tobytes(), tail.tobytes()))
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["key", "no", "last", "boundary", "n", "head", "tail"])

    return run


@F.pandas_udf(T.LongType())
def _dropped(tail: pd.Series, head: pd.Series, n: pd.Series, boundary: pd.Series) -> pd.Series:
    """Tokens that a splice leaves out: of the left chunk those after the symbol, of the right one those up to it."""
    out = []
    for x, y, all_left, at in zip(tail, head, n, boundary):
        found = splice(np.frombuffer(x, np.int64).reshape(-1, 4), np.frombuffer(y, np.int64).reshape(-1, 4), int(at))
        out.append(None if found is None else int(all_left) - found[0] + found[1])
    return pd.Series(out, dtype="Int64")


def _spliced(texts: DataFrame, held, size: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of each distinct key of ``texts`` (key, text); null tokens where a splice failed."""
    chunks = texts.mapInArrow(_cut(size, overlap), _CUT).dropDuplicates(["key", "no"])  # copies are encoded once; also spreads the chunks
    done = settled(chunks.mapInArrow(_encode(held), _ENCODED))
    after = done.where("no > 0").select("key", (F.col("no") - 1).alias("no"), F.col("head").alias("next"))
    pairs = done.where("NOT last").select("key", "no", "n", "tail", "boundary").join(after, ["key", "no"])
    lost = pairs.groupBy("key").agg(F.sum(_dropped("tail", "next", "n", "boundary")).alias("lost"), F.bool_or(_dropped("tail", "next", "n", "boundary").isNull()).alias("failed"))
    whole = done.groupBy("key").agg(F.sum("n").alias("n")).join(lost, "key", "left")
    tokens = F.when(~F.coalesce("failed", F.lit(False)), F.col("n") - F.coalesce("lost", F.lit(0)))
    return settled(whole.select("key", tokens.alias("n_tokens")))


def huge_counts(texts: DataFrame, held, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of the distinct keys of ``texts`` (key, text), by chunks.

    Overlaps double until every splice of a text is proven; a chunk is at least four of them, so
    that in the end a text is one chunk.
    """
    counts = _spliced(texts, held, size, overlap)
    done = counts.where("n_tokens IS NOT NULL")
    while counts.where("n_tokens IS NULL").take(1):
        overlap *= 2
        texts = texts.join(counts.where("n_tokens IS NULL").select("key"), "key", "left_semi")
        counts = _spliced(texts, held, max(size, 4 * overlap), overlap)
        done = done.union(counts.where("n_tokens IS NOT NULL"))
    return done


def count_tokens(docs: DataFrame, model: bytes, text_col: str = "text", out: str = "n_tokens", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with the long column ``out``, which replaces one of that name: tokens as the library gives them for the whole text.

    No begin, end or other added tokens. Null and empty texts have 0; rows stay repeated, copies of
    huge texts are encoded once. Texts of at most two chunks are encoded whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # one model file
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    columns = [f"`{c}`" for c in docs.columns if c != out]

    @F.arrow_udf(T.LongType())
    def whole(texts: pa.Array) -> pa.Array:
        own, _ = _processor(held.value)
        return pa.array([len(own.encode(t.as_py(), num_threads=1)) for t in texts], pa.int64())

    small = docs.where(F.length(text) <= 2 * size).select(*columns, whole(text).alias(out))
    keyed = fresh(docs, "__key")
    huge = docs.where(F.length(text) > 2 * size)
    if not huge.take(1):
        return small
    counts = huge_counts(huge.select(F.sha2(text, 256).alias("key"), text.alias("text")), held, size, overlap)
    counts = counts.select(F.col("key").alias(keyed), F.col("n_tokens").alias(fresh(docs, "__tokens")))
    known = huge.withColumn(keyed, F.sha2(text, 256)).join(counts, keyed)
    return small.union(known.select(*columns, F.col(fresh(docs, "__tokens")).alias(out)))


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver and sent to the workers."""
    with open(path, "rb") as file:
        return file.read()


def default_model() -> str:
    """Path of the public sentencepiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def utf8_bytes(text: Column) -> Column:
    """Bytes of the text in UTF-8; 0 for null."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether the tokens exceed the limit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs.withColumn("n_bytes", utf8_bytes(F.col("text"))), model_bytes(default_model()))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
