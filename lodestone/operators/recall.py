"""Recalling what was said before, judging moods, and when something is due; what a text repeats of a layer."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import words
from lodestone.sources.shared import settled

# Words that point back, with what they score; moods with their words and the tone of the answer; codes of categories.
BACK = ["上次", "之前", "之前说", "之前提到的", "之前说的"]
TIMES = [(8, ["上次", "之前"]), (6, ["一开始", "最开始"]), (7, ["最近", "刚才"])]
MOODS = {
    "joy": ["开心", "高兴", "快乐", "棒", "太好了", "哈哈", "真好"],
    "sadness": ["难过", "伤心", "哭", "悲伤", "郁闷", "不爽", "烦"],
    "anger": ["生气", "愤怒", "讨厌", "滚", "气死了", "可恶"],
    "fear": ["害怕", "担心", "焦虑", "紧张", "怕", "不安"],
    "excitement": ["兴奋", "激动", "太棒了", "wow", "厉害"],
    "fatigue": ["累", "疲惫", "困", "好累", "好困", "没精力"],
    "worry": ["担心", "忧虑", "发愁", "怎么办", "愁"],
}
TONES = {"joy": "活泼", "sadness": "温暖", "anger": "安抚", "fear": "安慰", "excitement": "共鸣", "fatigue": "关心", "worry": "关切"}
CODES = {"political": "C2", "violence": "C3", "pornography": "C4", "gambling": "C5", "drug": "C6", "hate": "C7", "fake": "C7"}


def _hits(low: Column, listed: list[str]) -> Column:
    return reduce(lambda x, y: x + y, [low.contains(w).cast("int") for w in listed])


def mood(text: Column) -> Column:
    """(mood, intensity, tone): the mood of most words that occur, the first of equals; neutral, 0.3 and normal without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counted = F.array(*[F.struct((-_hits(low, ws)).alias("n"), F.lit(i).alias("i"), F.lit(m).alias("mood"), F.lit(TONES[m]).alias("tone")) for i, (m, ws) in enumerate(MOODS.items())])
    best = F.array_min(counted)
    found = best["n"] < 0
    return F.struct(F.when(found, best["mood"]).otherwise("neutral").alias("mood"), F.when(found, F.least(F.round(-best["n"] * 0.3, 6), F.lit(1.0))).otherwise(0.3).alias("intensity"), F.when(found, best["tone"]).otherwise("normal").alias("tone"))


def category_code(category: Column) -> Column:
    """Code of a category; that of the first one where it is unknown."""
    return F.coalesce(*[F.when(category == k, v) for k, v in CODES.items()], F.lit("C2"))


def memories(asked: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """(query_id, session_id, score, method, place): the sessions of the asking user that a question recalls.

    ``asked`` has (query_id, user, said, entities), ``kept`` (session_id, user, summary); sessions
    without a summary go. An entity in the summary scores 10 and 15, a word that points back 5,
    and the first group of words of time 8, 6 or 7; only scores above 0 count, ties go to the
    least session.
    """
    both = asked.join(kept.where("summary <> ''"), "user")
    said, summary = F.lower("said"), F.lower("summary")
    named = F.size(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: summary.contains(F.lower(e))))
    keyword = named * 10 + _hits(said, BACK) * 5
    time = F.coalesce(*[F.when(_hits(said, ws) > 0, n) for n, ws in TIMES], F.lit(0))
    method = F.when(keyword > 0, "keyword").when(time > 0, "time").when(named > 0, "entity")
    scored = both.select("query_id", "session_id", (keyword + time + named * 15).alias("score"), method.alias("method")).where("score > 0")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "session_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def due(states: DataFrame, now: Column, turns: int, chars: int, cooldown: int) -> DataFrame:
    """``states`` (turns, chars, done_at) with ``summary_due`` and ``profile_due``: enough was said, and the last time was ``cooldown`` seconds ago or never."""
    cold = F.coalesce(F.unix_micros(now) - F.unix_micros("done_at") >= cooldown * 1_000_000, F.lit(True))
    enough = F.col("turns") >= turns
    return states.withColumn("summary_due", cold & (enough | (F.col("chars") >= chars))).withColumn("profile_due", cold & enough)


def dialog_contexts(turns: DataFrame, summaries: DataFrame, session: str, order: str, keep: int) -> DataFrame:
    """(session, context): the summary, where there is one, and the last ``keep`` turns (role, text) in order."""
    newest = W.partitionBy(session).orderBy(F.desc(order))
    last = turns.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= keep)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, F.concat_ws(": ", "role", "text").alias("t")))), lambda x: x["t"])
    said = last.groupBy(session).agg(F.array_join(lines, "\n").alias("said"))
    return said.join(summaries.select(session, "summary"), session, "left").select(session, F.concat_ws("\n", F.nullif("summary", F.lit("")), "said").alias("context"))


def repeats(new: DataFrame, kept: DataFrame, layer: str, text: str, order: str, least: float = 0.8, recent: int = 5) -> DataFrame:
    """``new`` with ``duplicate``: exact where the layer holds the text, similar where one of its ``recent`` latest has at least ``least`` of the words in common, else null."""
    held = kept.select(F.col(layer).alias("__l"), F.md5(text).alias("__k")).distinct()
    newest = kept.withColumn("__n", F.row_number().over(W.partitionBy(layer).orderBy(F.desc(order)))).where(F.col("__n") <= recent)
    bags = newest.groupBy(F.col(layer).alias("__m")).agg(F.collect_list(F.array_distinct(words(F.col(text)))).alias("__bags"))  # `recent` texts a layer
    both = new.join(held, (F.col(layer) == F.col("__l")) & (F.md5(text) == F.col("__k")), "left").join(bags, F.col(layer) == F.col("__m"), "left")
    own = F.array_distinct(words(F.col(text)))
    alike = F.exists("__bags", lambda b: F.size(F.array_intersect(b, own)) >= least * F.size(F.array_union(b, own)))
    found = F.when(F.col("__k").isNotNull(), "exact").when(F.coalesce(alike & (F.size(own) > 0), F.lit(False)), "similar")
    return both.withColumn("duplicate", found).select(*new.columns, "duplicate")


def places(docs: DataFrame, patterns: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, pattern, place): every occurrence of each pattern, case aside and overlapping ones too, from 1."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.col(id_col).alias("id"), low.alias("t"))
    parts = [own.where(F.col("t").contains(p.lower())).select("id", F.lit(p).alias("pattern"), F.explode(_starts(F.col("t"), p.lower())).alias("place")) for p in patterns if p]
    return reduce(DataFrame.union, parts)


def _starts(text: Column, pattern: str) -> Column:
    """Where a pattern starts: the lengths of what stands before, piece by piece."""
    # Each match is empty and looks ahead, so matches may overlap; the pieces between them have the places.
    pieces = F.split(text, f"(?={re.escape(pattern)})")
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    return F.filter(F.transform(ends, lambda n: n + 1), lambda n: F.substring(text, n, F.lit(len(pattern))) == pattern)


def crawled(links: DataFrame, start: DataFrame, depth: int, pages: int) -> DataFrame:
    """(url, hop): pages reached along ``links`` (src, dst) from ``start`` (url) in at most ``depth`` steps, the first ``pages`` by step and address."""
    links = settled(links.select("src", "dst").distinct())
    seen = settled(start.select("url").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        frontier = settled(reached.join(seen, "url", "left_anti").withColumn("hop", F.lit(hop)).orderBy("url").limit(pages))
        seen = seen.union(frontier)
    return seen.orderBy("hop", "url").limit(pages)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _neighbours(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts:
        found, before, other = [], None, 0
        if not text.is_valid:
            out.append(None)
            continue
        for listed in text.as_py():
            own = Counter(listed or [])
            square = sum(n * n for n in own.values())
            if before is not None:
                dot = sum(n * before[w] for w, n in own.items() if w in before)
                found.append(dot / (math.sqrt(square) * math.sqrt(other)) if dot else 0.0)
            else:
                found.append(None)
            before, other = own, square
        out.append(found)
    return pa.array(out, pa.list_(pa.float64()))


def neighbour_cosines(sentences: Column) -> Column:
    """For the sentences of a text the cosine of each one's word counts with the one before, null for the first.

    A text stays in its row, so that no word is shuffled.
    """
    return F.transform(_neighbours(F.transform(sentences, lambda x: words(x))), lambda c: F.round(c, 6))


def sentence_cosines(sentences: DataFrame, doc: str) -> DataFrame:
    """(doc, alike): :func:`neighbour_cosines` of texts whose ``sentences`` are rows (doc, i, text) with i from 0."""
    whole = sentences.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("__s"))  # sentences of one text
    return whole.select(doc, neighbour_cosines(F.col("__s.text")).alias("alike"))
