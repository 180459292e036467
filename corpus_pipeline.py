"""Corpus pipeline: five stages over ``documents``, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, copies, decontam, pii, quality
from lodestone.llm.names import fresh
from lodestone.session import ship
from lodestone.sources.shared import new_folder, remove


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote doesn't reject (score at least 0.3)."""
    ship(spark)
    score = fresh(docs, "quality_score")
    scored = quality.score_documents(docs, quality.fit_tables(spark, sf_dir), out=score)
    return scored.where(F.col(score) >= quality.CUT).select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard at least 0.8): that of the least id."""
    ship(spark)
    return copies.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; n_chars follows the new text."""
    counts = fresh(docs, "pii_counts")
    done = pii.replace_entities(docs, pii.DEMO_KEY, out=counts).drop(counts)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian unsigned 32-bit), their number, and whether they spell it again.

    All columns stay; one named ``token_ids``, ``n_tokens`` or ``round_trip`` is replaced.
    """
    ship(spark)
    path, pattern = bpe.default_vocabulary()
    ids, back = fresh(docs, "__ids"), fresh(docs, "__back")
    both = bpe.decode_documents(bpe.encode_documents(docs, path, pattern, out=ids), path, pattern, ids_col=ids, out=back)
    made = {
        "token_ids": F.col(ids),
        "n_tokens": (F.octet_length(ids) / 4).cast("long"),
        "round_trip": F.col(back) == F.coalesce("text", F.lit("")).cast("binary"),
    }
    return both.select(*[f"`{c}`" for c in docs.columns if c not in made], *[c.alias(n) for n, c in made.items()])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("bpe_tokens", bpe_tokens),
]

#: The votes, fingerprints and merges are beyond SQL; the tests hold the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and reread, and the one before it removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = new_folder(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
