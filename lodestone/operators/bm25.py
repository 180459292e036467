"""Lexical search: postings, corpus statistics and BM25 ranking for a table of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from lodestone.functions.text import index_terms
from lodestone.sources.shared import settled

K1, B = 1.5, 0.75


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf) for each term of each document; documents without terms have no row. Ids are unique."""
    return counted(docs, id_col, index_terms(F.col(text_col))).select("id", "term", "tf")


def counted(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, dl, term, tf) of each distinct term in a row's array, counted in the row itself: nothing is shuffled."""
    own = docs.select(F.col(id_col).alias("id"), terms.alias("terms"))
    schema = T.StructType([own.schema["id"], T.StructField("dl", T.LongType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                listed = batch.column(1)
                size = pc.list_value_length(listed).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                said = listed.flatten().dictionary_encode()
                words = max(1, len(said.dictionary))
                met, tf = np.unique(np.repeat(np.arange(len(size)), size) * words + said.indices.to_numpy(), return_counts=True)
                row, code = met // words, met % words
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(size[row]), said.dictionary.take(pa.array(code)), pa.array(tf)], ["id", "dl", "term", "tf"])

    return own.mapInArrow(count, schema)


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl): number of index terms, repeats included; no shuffle."""
    return docs.select(F.col(id_col).alias("id"), F.size(index_terms(F.col(text_col))).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: n_docs and avgdl."""
    return doc_lengths(docs, id_col, text_col).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def doc_freq(post: DataFrame) -> DataFrame:
    """(term, df) from postings."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(searches: DataFrame) -> DataFrame:
    """(query_id, term, qf): terms of each query with their number; a term said twice counts twice."""
    said = searches.select("query_id", F.explode(index_terms(F.col("query"))).alias("term"))
    return said.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def ranked(hits: DataFrame, terms: DataFrame, df: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) from hits (id, dl, term, tf), document frequencies and one row of statistics."""
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    scored = (
        hits.join(df, "term")
        .crossJoin(F.broadcast(stats))  # one row
        .join(terms, "term")
        .groupBy("query_id", "id")
        .agg(F.round(F.sum(F.col("qf") * idf * F.col("tf") * (K1 + 1) / norm), 6).alias("score"))
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_search(
    docs: DataFrame, searches: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", most: int = 10_000
) -> DataFrame:
    """Top ``k`` documents of each query by BM25.

    ``searches`` has (query_id, query); each distinct text is searched for once. Documents are read and cut into terms once; only their
    lengths and the query terms in them leave the scan. More than ``most`` distinct query terms
    are joined instead of being looked up in each task. Returns (query_id, id, score, rank);
    ties go to the smaller id, documents without a query term never appear.
    """
    texts = searches.where("query IS NOT NULL").select(F.col("query").alias("query_id"), "query").distinct()
    terms = settled(query_terms(texts))
    wanted = [r.term for r in terms.select("term").distinct().limit(most + 1).collect()]
    occur = docs.select(F.col(id_col).alias("id"), index_terms(F.col(text_col)).alias("terms"))
    found = F.filter("terms", lambda t: t.isin(wanted)) if len(wanted) <= most else F.col("terms")
    occur = settled(occur.select("id", F.size("terms").cast("long").alias("dl"), found.alias("found")))
    stats = occur.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    hits = occur.select("id", "dl", F.explode("found").alias("term"))
    if len(wanted) > most:
        hits = hits.join(terms.select("term").distinct(), "term", "left_semi")
    hits = hits.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    found = ranked(hits, terms, doc_freq(hits), stats, k).withColumnRenamed("query_id", "query")
    return searches.select("query_id", "query").join(found, "query").select("query_id", "id", "score", "rank")


def save_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write postings (id, dl, term, tf), document frequencies and corpus statistics below ``path``."""
    lengths = doc_lengths(docs, id_col, text_col)
    post = counted(docs, id_col, index_terms(F.col(text_col)))
    post.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    kept = docs.sparkSession.read.parquet(f"{path}/postings")
    doc_freq(kept).write.mode("overwrite").parquet(f"{path}/doc_freq")
    lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")


def search_index(spark: SparkSession, path: str, searches: DataFrame, k: int = 10, most: int = 10_000) -> DataFrame:
    """:func:`bm25_search` over a saved index; postings are sorted by term, so files without a query term are skipped."""
    terms = settled(query_terms(searches))
    wanted = [r.term for r in terms.select("term").distinct().limit(most + 1).collect()]
    post, df, stats = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "doc_freq", "stats"))
    hits = post.where(F.col("term").isin(wanted)) if len(wanted) <= most else post.join(terms.select("term").distinct(), "term", "left_semi")
    return ranked(hits, terms, df, stats, k)
