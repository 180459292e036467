"""Dictionary screening: categories, codes and a verdict that doesn't depend on timing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import words as text_words

#: Items of a bank and their characters, and keywords of a dictionary, that one pass sends out.
BANK_BLOCK, BANK_CHARS, KEYWORDS_PER_PASS = 50_000, 2_000_000, 10_000
#: Our own small neutral dictionary: (keyword, category, code). Categories may share a code.
RULES = (
    ("blend", "kitchen", "C2"), ("pathetic", "rude", "C3"), ("worthless", "rude", "C3"), ("token", "credential", "C4"),
    ("license", "legal", "C7"), ("licensed", "notice", "C7"), ("apache", "notice", "C8"), ("@mail", "contact", "C9"),
)


def detections(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keyword, category, code) for each keyword that a text contains, case aside.

    A dictionary of any size may be given: blocks of at most :data:`KEYWORDS_PER_PASS` rows go
    to every task, and each takes one scan of the texts, which are lower-cased once.
    """
    n = rules.count()
    passes = max(1, -(-2 * n // KEYWORDS_PER_PASS)) if n > KEYWORDS_PER_PASS else 1  # half full on average
    lower = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    out = []
    for k in range(passes):
        words = [tuple(r) for r in rules.where(F.pmod(F.xxhash64("keyword"), F.lit(passes)) == k).select("keyword", "category", "code").collect()]
        entry = F.array(*[F.struct(F.lit(w.lower()).alias("low"), F.lit(w).alias("keyword"), F.lit(c).alias("category"), F.lit(n).alias("code")) for w, c, n in words])
        if not words:
            continue
        hits = lower.select("id", F.explode(F.filter(entry, lambda e: F.col("low").contains(e["low"]))).alias("h"))
        out.append(hits.select("id", "h.keyword", "h.category", "h.code"))
    if not out:
        return lower.limit(0).select("id", *[F.lit("").alias(c) for c in ("keyword", "category", "code")])
    return reduce(DataFrame.unionByName, out)


def first_hits(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, place): the word of the list that comes first in a text, and where, from 1; ties to the first listed."""
    text = F.col(text_col)
    found = F.array(*[F.struct(F.nullif(F.position(F.lit(w), text), F.lit(0)).alias("place"), F.lit(i).alias("i"), F.lit(w).alias("word")) for i, w in enumerate(words)])
    first = F.array_min(F.filter(found, lambda x: x["place"].isNotNull()))
    hits = docs.select(F.col(id_col).alias("id"), first.alias("f")).where("f IS NOT NULL")
    return hits.select("id", "f.word", F.col("f.place").cast("long").alias("place"))


def segmented(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keyword, way): listed words that a text contains (substring), or that are one of its words in lower case (word)."""
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), text_words(F.col(text_col)).alias("w"))
    ways = [(F.lit(w), F.col("t").contains(w), F.array_contains("w", w)) for w in words]
    made = [F.when(hit, F.struct(w.alias("keyword"), F.lit(way).alias("way"))) for w, part, whole in ways for hit, way in ((part, "substring"), (whole, "word"))]
    return cut.select("id", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("h")).select("id", "h.*")


def staged(docs: DataFrame, blocked: list[str], rules: DataFrame, bank: DataFrame) -> DataFrame:
    """(doc_id, code, reason) of the first stage that finds something; the stages go by their codes, not by time.

    C1 is a blocked word, C2 and on the dictionary's least code, C35 an item of the bank (the least).
    """
    one = first_hits(docs, blocked).select(F.col("id").alias("doc_id"), F.lit(1).alias("stage"), F.lit("C1").alias("code"), F.col("word").alias("reason"))
    two = verdicts(detections(docs, rules)).select(F.col("id").alias("doc_id"), F.lit(2).alias("stage"), "code", F.lit("category").alias("reason"))
    held = contained(docs.select("doc_id", "text"), bank).groupBy("doc_id").agg(F.min("item_id").alias("item"))
    three = held.select("doc_id", F.lit(3).alias("stage"), F.lit("C35").alias("code"), F.concat(F.lit("item "), "item").alias("reason"))
    best = one.unionByName(two).unionByName(three).groupBy("doc_id").agg(F.min(F.struct("stage", "code", "reason")).alias("r"))
    return best.select("doc_id", "r.code", "r.reason")


def verdicts(found: DataFrame) -> DataFrame:
    """(id, code, categories): the code of least number decides; categories are distinct."""
    number = F.substring("code", 2, 9).cast("int")
    return found.groupBy("id").agg(F.concat(F.lit("C"), F.min(number).cast("string")).alias("code"), F.countDistinct("category").alias("categories"))


def contained(docs: DataFrame, bank: DataFrame, block: int = BANK_BLOCK, chars: int = BANK_CHARS) -> DataFrame:
    """(doc_id, item_id) of each item of ``bank`` (item_id, text) that a text contains, case kept.

    About ``block`` items and ``chars`` characters go to the tasks at a time, as one automaton that
    finds all of them in one walk over a text; a larger bank takes one pass over the texts for each
    of its blocks. Texts reach Python in batches of few rows, so that a worker's memory doesn't grow
    with the rows of a task. Null and empty items and null texts match nothing.
    """
    items = bank.where("text <> ''").select("item_id", "text")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    passes = max(1, -(-size.n // block), -(-size.chars // chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    kind = T.ArrayType(bank.schema["item_id"].dataType)
    found = []
    for i in range(passes):
        listed: dict[str, list] = {}
        for r in items.where(part == i).distinct().collect():  # about `block` items
            listed.setdefault(r.text, []).append(r.item_id)
        held = docs.sparkSession.sparkContext.broadcast(listed)
        hits = F.udf(_walk(held), kind, useArrow=False)  # a hundred rows at a time, whatever Arrow's batches hold
        found.append(docs.select("doc_id", F.explode(hits("text")).alias("item_id")))
    return reduce(DataFrame.unionByName, found)


def _walk(held: Broadcast) -> Callable[[str | None], list]:
    """A function from a text to the ids of the items of ``held`` that it contains; a task makes the automaton once."""
    made = []

    def run(text: str | None) -> list:
        if not text or not held.value:
            return []
        if not made:
            walk = ahocorasick.Automaton()
            for item, ids in held.value.items():
                walk.add_word(item, ids)
            walk.make_automaton()
            made.append(walk)
        return list({item for _, ids in made[0].iter(text) for item in ids})

    return run
