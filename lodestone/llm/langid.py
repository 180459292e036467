"""Language identification by words first, backing off to ever shorter character n-grams.

Known words are scored by their log frequency in each language. A word that the model does
not hold is scored by its 4-grams, or where it holds none of those by 3-, 2- and 1-grams.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.names import fresh
from lodestone.llm.quality import held_out
from lodestone.sources.shared import settled

#: Most labelled documents that a model is fitted on: the first by hash of doc_id.
MAX_LABELLED = 3000
LONGEST = 4
SMOOTH = 0.5
UNKNOWN = "und"
FOLDS, LEFT = 4, 2
#: Unseen words whose vectors a worker keeps; beyond it the table starts anew.
KEPT = 150_000
#: Texts, and characters of them, whose unseen words are looked up together.
BLOCK, BLOCK_CHARS = 512, 4_000_000

_RUNS = re.compile(r"[^\W\d_]+").findall
#: Signs that count as word characters but are no letters, such as ² and ½; a class this large is slow, so it only parts the words that hold one.
_SIGNS = re.compile("[" + re.escape("".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())) + "]+").split


def words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    found = _RUNS(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in ([w] if w.isalpha() else filter(None, _SIGNS(w)))]


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word between two blanks; single letters without the blanks."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Log frequencies: rows of ``table`` by term, columns by language."""

    langs: list[str]
    rows: dict[str, int]  # words as they are, n-grams after their length
    table: np.ndarray
    seen: dict[str, int] = field(default_factory=dict)  # unseen words → row after the table's, -1 for none
    extra: np.ndarray | None = None

    def longest_known(self, word: str) -> list[int]:
        """Rows of the longest n-grams that are known; empty without any."""
        get = self.rows.get
        for n in range(LONGEST, 0, -1):
            known = [r for g in grams(word, n) if (r := get(f"{n}{g}")) is not None]
            if known:
                return known
        return []

    def back_off(self, word: str) -> np.ndarray | None:
        """Mean vector of the longest known n-grams."""
        known = self.longest_known(word)
        return self.table[known].mean(axis=0) if known else None

    def _learn(self, unseen: list[str]) -> None:
        """Vectors of unseen words, all at once."""
        found = [self.longest_known(w) for w in unseen]
        sizes = np.array([len(f) for f in found])
        base = len(self.extra)
        rows = np.array([r for f in found for r in f], np.int64)
        has = sizes > 0
        if has.any():
            starts = (np.cumsum(sizes) - sizes)[has]
            means = np.add.reduceat(self.table[rows], starts, axis=0) / sizes[has][:, None]
            self.extra = np.vstack([self.extra, means])
        places = np.where(has, base + np.cumsum(has) - 1, -1)
        self.seen.update(zip(unseen, places.tolist()))

    def predict_block(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its share of the likelihood, over at most 20 words' worth of evidence."""
        if self.extra is None or len(self.seen) > KEPT:
            self.seen, self.extra = {}, self.table
        counted = [Counter(words(t)) if t else Counter() for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        rows, seen = self.rows, self.seen
        unseen = {w: None for own in counted for w in own if w not in rows and w not in seen}
        if unseen:
            self._learn(list(unseen))
        out = []
        for own in counted:
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            at = np.array([rows[w] if w in rows else seen[w] for w in own], np.int64)
            times = np.fromiter(own.values(), np.float64, len(own)) * (at >= 0)
            n = max(times.sum(), 1.0)
            mean = times @ self.extra[at] / n
            share = np.exp((mean - mean.max()) * min(n, 20))
            best = int(np.argmax(mean))  # ties: the first language in order
            out.append((self.langs[best], round(float(share[best] / share.sum()), 6)))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The same for one text."""
        return self.predict_block([text])[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) → (lang, word, times) of each batch."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.setdefault(lang, Counter()).update(words(text))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang for lang, own in found.items() for _ in own], pa.string()),
             pa.array([w for own in found.values() for w in own], pa.string()),
             pa.array([k for own in found.values() for k in own.values()], pa.int64())],
            ["lang", "term", "times"],
        )


def _terms(counts: DataFrame, n: int) -> DataFrame:
    """(n, lang, term, times) of the n-grams, from the counts of distinct words; 0 stands for the words themselves."""
    if not n:
        return counts.select(F.lit(0).alias("n"), "lang", "term", "times")
    padded = F.concat(F.lit(" "), "term", F.lit(" ")) if n > 1 else F.col("term")
    cut = F.transform(F.sequence(F.lit(1), F.length("p") - n + 1), lambda i: F.substring(F.col("p"), i, F.lit(n)))
    found = counts.select("lang", "times", padded.alias("p")).where(F.length("p") >= n)
    return found.select(F.lit(n).alias("n"), "lang", F.explode(cut).alias("term"), "times")


def fit(docs: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """A model from (doc_id, text, lang) rows with text and language, at most ``limit`` ids.

    Counting is distributed; all words and n-grams of the sample reach the driver, whose number
    the sample bounds. With one language in the sample that is what every text with letters gets.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    picked = known.join(F.broadcast(chosen), known["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi")  # at most `limit` ids
    counts = picked.select("lang", "text").mapInArrow(_count, "lang string, term string, times long")
    counts = settled(counts.groupBy("lang", "term").agg(F.sum("times").alias("times")))
    every = reduce(DataFrame.union, [_terms(counts, n) for n in range(LONGEST + 1)]).groupBy("n", "lang", "term").agg(F.sum("times").alias("times"))
    found = every.orderBy("n", "term", "lang").toArrow()
    names = np.array(found["lang"].to_pylist(), object)
    langs = sorted(set(names))
    kinds, terms = found["n"].to_pylist(), found["term"].to_pylist()
    rows: dict[str, int] = {}
    at = np.array([rows.setdefault((f"{n}" if n else "") + term, len(rows)) for n, term in zip(kinds, terms)], np.int64)
    table, kind = np.zeros((len(rows), len(langs))), np.zeros(len(rows), int)
    column = {lang: i for i, lang in enumerate(langs)}
    table[at, [column[x] for x in names]] = found["times"].to_numpy()
    kind[at] = kinds
    for n in range(LONGEST + 1):
        own = kind == n
        table[own] = np.log((table[own] + SMOOTH) / (table[own].sum(axis=0) + SMOOTH * max(1, own.sum())))
    return Model(langs, rows, table)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, in place of columns of these names; und and 0 where text is null or has no letter."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    result = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    @F.arrow_udf(result)
    def predict(texts: pa.Array) -> pa.Array:
        found, block, size = [], [], 0
        for text in texts:
            block.append(text.as_py())
            size += len(block[-1] or "")
            if len(block) == BLOCK or size >= BLOCK_CHARS:
                found += held.value.predict_block(block)
                block, size = [], 0
        found += held.value.predict_block(block)
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "lang_score"]
        )

    keep = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "lang_score")]
    made = fresh(docs, "__l")
    return docs.withColumn(made, predict("text")).select(*keep, f"{made}.lang_pred", f"{made}.lang_score")


def op9_language_backoff(spark, sf_dir: str) -> DataFrame:
    """Language of every document; learnt only outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out(FOLDS, LEFT)))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(FOLDS, LEFT).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
