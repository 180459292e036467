"""URL filter: rules by host and path, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS, SHORTEST, LONGEST = 12, 3, 5
ROUNDS, RATE, SHRINK = 400, 8.0, 1e-4
#: Most labelled URLs that are taken to the driver.
MAX_LABELLED = 20_000

#: Rules of the registered query, (host/path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The small labelled table of the registered query: words of unwanted and wanted hosts and paths.
UNWANTED = ("casino", "casino-win", "free-bets", "poker", "jackpot", "betting", "slots", "cheap-pills", "pills", "viagra", "pharmacy-deal",
            "xxx", "porn", "adult-x", "adult-cams", "ads-track", "ad-tracker", "free-money", "loan-fast", "crypto-doubler", "replica-watch", "click-here", "win-prize")
WANTED = ("blog", "news", "www", "m", "library", "university", "museum", "wiki", "docs", "weather", "recipes", "city", "school",
          "health", "science", "travel", "sport", "music", "books", "garden")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block): the two word lists and invented names in the same frames.

    Every frame (prefix, domain, path) occurs with either label, so that only the names tell.
    """
    heads, ends = ("ba", "co", "di", "fe", "gre", "hu", "ka", "lo", "mi", "ne", "th", "ti", "re"), ("ring", "tion", "and", "er", "on", "ble", "st", "ha", "es", "en", "rha", "thst")
    invented = tuple(a + b for a in heads for b in ends)
    frames = [(f"{p}{{}}.example.{t}", s) for p, t, s in zip(
        ("", "www.", "m.", "blog.", "www.", ""), ("com", "org", "net", "com", "net", "org"), ("en/12", "fr/7/", "es/88", "de/345.html", "en/9013", "es/4"))]
    rows = [(f"http://{h.format(w)}/{s}", y) for words, y in ((UNWANTED, 1), (WANTED + invented, 0)) for w in words for h, s in frames]
    rows += [(f"https://example.org/{w}/best", 1) for w in UNWANTED] + [(f"https://example.org/{w}/best", 0) for w in WANTED + invented]
    return [*rows, ("", 0)]


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host_col: Column, path_col: Column, rules: tuple) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host, subdomains and path start; else nulls.

    Of rules of equal length the first in order by text is taken.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=True)[::-1]:
        name, slash, rest = text.partition("/")
        fits = (host_col == name) | host_col.endswith(f".{name}")
        if slash:
            fits &= path_col.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def hashed(host_text: str, path_text: str) -> np.ndarray:
    """Indices of the distinct character n-grams of host and path, host and path apart."""
    found = set()
    for tag, text in (("h", host_text), ("p", path_text)):
        marked = f"^{text}$"
        for n in range(SHORTEST, LONGEST + 1):
            found.update(f"{tag}{marked[i : i + n]}" for i in range(len(marked) - n + 1))
    return np.array(sorted({zlib.crc32(g.encode("utf-8", "replace")) & (1 << BITS) - 1 for g in found}), np.int64)


@dataclass
class Model:
    """Weights by hashed n-gram; the last one is the offset."""

    weights: np.ndarray

    def probability(self, host_text: str, path_text: str) -> float:
        """Of the label to block; n-grams count by the root of their number."""
        index = hashed(host_text, path_text)
        z = self.weights[index].sum() / np.sqrt(max(1, len(index))) + self.weights[-1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(table: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Logistic regression from (url, label 0/1), by full-batch gradient steps on the driver.

    The table must be small: more than ``limit`` rows are refused, none is dropped. Rows
    with a null label teach nothing; an empty table gives even odds.
    """
    rows = table.where("label IS NOT NULL").select(host(F.col("url")), path(F.col("url")), "label").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the labelled table has more than {limit} rows")
    grams = [hashed(h, p) for h, p, _ in rows]
    sizes = np.array([max(1, len(g)) for g in grams], np.int64)
    flat = np.concatenate([g if len(g) else np.array([1 << BITS]) for g in grams]) if rows else np.zeros(0, np.int64)
    row, scale = np.repeat(np.arange(len(rows)), sizes), 1 / np.sqrt(sizes)
    y = np.array([r[2] for r in rows], np.float64)
    weights = np.zeros((1 << BITS) + 1)
    for _ in range(ROUNDS if len(rows) else 0):
        z = np.bincount(row, weights[flat] * (flat < 1 << BITS), len(rows)) * scale + weights[-1]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.bincount(flat, (miss * scale)[row], len(weights))
        slope[-1] = miss.sum()
        weights -= RATE * (slope / len(y) + SHRINK * np.r_[weights[:-1], 0])
    return Model(weights)


def judge(pages: DataFrame, model: Model, rules: tuple = RULES, cut: float = 0.5, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, probability and verdict (allow or block).

    URLs are taken whole, however long, and repeated rows are judged alike. A rule's verdict goes
    before the model's. A null URL or one without :// has empty host
    and path; the labelled table holds the empty URL as wanted. Columns of these names are
    replaced.
    """
    held = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def probability(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        known: dict[tuple[str, str], float] = {}
        out = []
        for key in zip(hosts.to_pylist(), paths.to_pylist()):
            if key not in known:
                known[key] = held.value.probability(*key)
            out.append(known[key])
        return pa.array(out, pa.float64())

    made = ("host", "path", "rule", "probability", "verdict")
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    cut_up = pages.select(*rest, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    rule, says = best_rule(F.col("host"), F.col("path"), rules)
    scored = cut_up.withColumn("probability", probability("host", "path"))
    own = F.when(F.col("probability") >= cut, "block").otherwise("allow")
    return scored.select("*", rule.alias("rule"), F.coalesce(says, own).alias("verdict"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict, with the model's probability."""
    model = fit(spark.createDataFrame(labelled_urls(), "url string, label int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", F.round("probability", 6).alias("probability"))
