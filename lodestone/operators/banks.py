"""Banks of questions and stores of vectors by text: read part by part, kept with a manifest, matched by meaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.vectors import cosine, score_queries
from lodestone.sources.shared import new_folder


def bank(sheets: dict[str, tuple[DataFrame, dict[str, str]]], keep: str = "length(question) >= 2") -> DataFrame:
    """(code, question, risk, sheet): rows of all sheets under one schema.

    ``sheets`` gives for each name a table and which of its columns (or SQL over them) are
    ``question``, ``risk`` and ``code``; a missing one is null. Blanks around a question go, and
    questions that ``keep`` doesn't hold for.
    """
    rows = [df.select(F.expr(m.get("code", "CAST(NULL AS STRING)")).alias("code"), F.trim(F.expr(m["question"])).alias("question"), F.expr(m.get("risk", "CAST(NULL AS STRING)")).alias("risk"), F.lit(name).alias("sheet")) for name, (df, m) in sheets.items()]
    return reduce(DataFrame.unionByName, rows).where(keep)


def kept_once(spark: SparkSession, made: DataFrame, purpose: str) -> DataFrame:
    """``made`` written as Parquet to a new folder and read from there, so that it is made once."""
    folder = new_folder(spark, purpose)
    made.write.parquet(folder)
    return spark.read.parquet(folder)


def save_store(rows: DataFrame, path: str, part: str) -> None:
    """Add rows (text, …) to a store as part files: one folder for each value of ``part``."""
    rows.write.mode("append").partitionBy(part).parquet(path)


def load_store(spark: SparkSession, path: str, part: str, key: str = "text") -> DataFrame:
    """The rows of all parts, of each key that of the last part; rows without a key go.

    Within a part the greatest row stays.
    """
    rows = spark.read.parquet(path).where(F.col(key).isNotNull())
    rest = [c for c in rows.columns if c not in (key, part)]
    last = rows.groupBy(key).agg(F.max(F.struct(part, *rest)).alias("r"))
    return last.select(key, F.col(f"r.{part}").alias(part), *[F.col(f"r.{c}").alias(c) for c in rest])


def manifest(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """How many rows a store's files hold, by ``by``, with how many files."""
    rows = spark.read.parquet(path).select("*", "_metadata.file_path")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("file_path").alias("files"))


def with_defaults(rows: DataFrame, key: str, **defaults: object) -> DataFrame:
    """Rows with a key, the missing fields of each filled; a column that isn't there is made."""
    have = rows.where(F.col(key).isNotNull())
    return have.select(*[c for c in rows.columns if c not in defaults], *[F.coalesce(F.col(c) if c in rows.columns else F.lit(None), F.lit(v)).alias(c) for c, v in defaults.items()])


def similarity_of(pairs: DataFrame, store: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with ``score``: the cosine of the stored vectors of two texts, 0 where the store misses one."""
    one = store.select(F.col("text").alias(left), F.col("vec").alias("__x"))
    two = store.select(F.col("text").alias(right), F.col("vec").alias("__y"))
    both = pairs.join(one, left, "left").join(two, right, "left")
    return both.withColumn("score", F.coalesce(F.round(cosine(F.col("__x"), F.col("__y")), 6), F.lit(0.0))).drop("__x", "__y")


def best_questions(bank_vectors: DataFrame, asked: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(query_id, code, id, score): for each query and code the bank's most similar question, where it reaches the code's threshold.

    ``bank_vectors`` has (id, vec, code), ``asked`` (query_id, query_vec). Ties go to the least id.
    """
    codes = bank_vectors.where(F.col("code").isin(list(thresholds)))
    scored = score_queries(codes, asked, "id", "vec", least=min(thresholds.values()), k=1, by="code")
    bar = F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("code"))
    best = scored.where(F.col("score") >= bar).groupBy("query_id", "code").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    return best.select("query_id", "code", F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


def updated_lines(text: Column, new: dict[str, Column]) -> Column:
    """A text of lines ``label: value`` with new values: a line of the label is replaced, a label without a line is added at the end.

    Labels whose new value is null stay as they are.
    """
    names = F.array(*[F.lit(k) for k in new])
    values = F.map_filter(F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    lines = F.split(text, "\n")
    label = lambda line: F.regexp_extract(line, r"^([^:]*):", 1)
    put = lambda k: F.concat(k, F.lit(": "), F.element_at(values, k))
    replaced = F.transform(lines, lambda line: F.when(F.map_contains_key(values, label(line)), put(label(line))).otherwise(line))
    missing = F.filter(names, lambda k: F.map_contains_key(values, k) & ~F.array_contains(F.transform(lines, label), k))
    return F.array_join(F.concat(replaced, F.transform(missing, put)), "\n")


def merged_maps(old: Column, new: Column) -> Column:
    """Entries of both maps, those of the newer one instead of the older one's; a null map has none."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def newest(rows: DataFrame, layer: str, order: list[Column], limit: int) -> DataFrame:
    """The newest ``limit`` rows of every layer, with ``place`` from 1."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(layer).orderBy(*order))).where(F.col("place") <= limit)


def blocked_and_candidates(found: DataFrame, codes: list[str], least: float, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(blocked, candidates) written and read again: all that is blocked, and of ``codes`` what is at least so similar."""
    folder = new_folder(spark, "blocked")
    found.write.parquet(f"{folder}/blocked")
    blocked = spark.read.parquet(f"{folder}/blocked")
    blocked.where(F.col("code").isin(codes) & (F.col("score") >= least)).write.parquet(f"{folder}/candidates")
    return blocked, spark.read.parquet(f"{folder}/candidates")
