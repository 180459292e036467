"""Spelling variants: words one edit apart, by bands of a letter-parity mask.

A word's mask has a bit for each letter, set where the letter occurs an odd number of times. One
edit flips at most two bits, so of three bands at least one is equal. Words are joined on an equal
band and on lengths that differ by at most one; the key also holds half of the word: an edit
leaves the first or the second half (of the shorter word's length) as it was, from which side is
counted being part of the key. Of the keys that a pair shares only the first is taken. What meets
is verified by the whole masks and then by the edit itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.crcsql import TABLE, crc32_sql
from lodestone.sources.shared import settled

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of the masks by band, dealt by how common they are; every other letter has a bit by its code point.
BANDS = ("eslfbzxj", "atrdmgvw", "inocuphyqk")
BAND_BITS = 16
#: Words of fewer code points or fewer occurrences are left out; a form has at least so many times the word's occurrences.
SHORTEST, LEAST, TIMES = 7, 2, 10


def _parity(word: Column, letter: str) -> Column:
    return (F.length(word) - F.length(F.replace(word, F.lit(letter), F.lit("")))).bitwiseAND(1)


def _of_band(b: int):
    return lambda c: F.ascii(c) % 3 == b


def _flip(first: int):
    """Flips the bit of a character that shares one of the bits from ``first`` on."""
    return lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1), (F.floor(F.ascii(c) / 3) % (BAND_BITS - first) + first).cast("int")))


def masks(word: Column) -> Column:
    """Array of the three bands as integers.

    A band has a bit for each of its own letters; all other characters share the bits above,
    by code point modulo 3 (the band) and the remaining bits (the place).
    """
    own = [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(_parity(word, c), i) for i, c in enumerate(band)]) for band in BANDS]
    rest = F.regexp_extract_all(word, F.lit(f"[^{''.join(BANDS)}]"), F.lit(0))
    bands = []
    for b, (bits, letters) in enumerate(zip(own, BANDS)):
        bands.append(F.aggregate(F.filter(rest, _of_band(b)), bits.cast("int"), _flip(len(letters))))
    return F.array(*bands)


def _halves(word: Column, short: Column) -> tuple[Column, Column]:
    """First and last part of the word, by the length of the shorter word of a pair."""
    half = F.floor(short / 2).cast("int")
    return F.substring(word, F.lit(1), half), F.substring(word, F.length(word) - (short - half) + 1, short - half)


def _keys(words: DataFrame, short: Column) -> DataFrame:
    """A row for each key of each word; ``short`` is the length of a pair's shorter word."""
    first, last = _halves(F.col("word"), short)
    each = [F.struct(F.xxhash64(F.lit(b), F.col("m")[b], F.lit(side), short, part).alias("key"), F.lit(b).alias("band"), F.lit(side).alias("side")) for b in range(3) for side, part in enumerate((first, last))]
    return words.select("word", "n", "m", F.length("word").alias("size"), F.explode(F.array(*each)).alias("k")).select("word", "n", "m", "size", "k.*")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of ``words`` (word, n; each word once) one edit apart, once.

    Of words of equal length ``a`` is the smaller, else the shorter one.
    """
    marked = settled(words.select("word", F.col("n").cast("long").alias("n"), masks(F.col("word")).alias("m")))
    size = F.length("word")
    left = _keys(marked, size).select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("m").alias("m_a"), F.col("size").alias("size_a"), "key", "band", "side")
    right = _keys(marked, size).union(_keys(marked, size - 1)).select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("m").alias("m_b"), F.col("size").alias("size_b"), F.col("key").alias("key_b"))
    flips = reduce(lambda x, y: x + y, [F.bit_count(F.col("m_a")[i].bitwiseXOR(F.col("m_b")[i])) for i in range(3)])
    order = (F.col("size_b") == F.col("size_a") + 1) | ((F.col("size_b") == F.col("size_a")) & (F.col("a") < F.col("b")))
    same = [F.col("m_a")[i] == F.col("m_b")[i] for i in range(3)]
    first_band = ((F.col("band") == 0) | ~same[0]) & ((F.col("band") < 2) | ~same[1])
    half = F.floor(F.col("size_a") / 2).cast("int")
    first_side = (F.col("side") == 0) | (F.substring("a", F.lit(1), half) != F.substring("b", F.lit(1), half))
    met = left.join(right, (F.col("key") == F.col("key_b")) & order & (flips <= 2) & first_band & first_side)
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row of ``forms`` (word, form): the end of the chain of forms, by doubling the steps.

    Chains must not be circular.
    """
    up = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        nxt = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = settled(up.join(nxt, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = stepped.select("word", "root")
        if not stepped.where("moved").take(1):
            return up


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of ``words`` (word, n; each word once).

    Two words are near if one inserted, deleted or replaced code point makes one the other. A
    word's form is the near word of largest n (ties: the smallest in code-point order), if it has
    at least ``times`` the word's n, and null otherwise; its root is the end of the chain of forms,
    the word itself without a form. Null words are left out; an empty table gives an empty result.
    ``times`` must be above 1, so that chains end.
    """
    if times <= 1:
        raise ValueError("times must be above 1")
    words = settled(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    pairs = settled(near_pairs(words))
    both = pairs.select(F.col("a").alias("near_of"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("near_of").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, F.col("word") == F.col("near_of"), "left")
    has = -F.col("best.less") >= F.col("n") * times
    found = settled(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs(text: Column, least: int) -> Column:
    """Array of the maximal runs of at least ``least`` Latin letters, A-Z in lower case; empty for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))


def with_slips(doc_id: Column, word: Column, one_in: int = 31) -> Column:
    """The word, of one in 31 by the CRC-32 of ``doc_id:word`` without one code point; a null id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents, with the slips that the query's rule plants."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", F.explode(runs(F.col("text"), SHORTEST)).alias("run"))
    words = found.select(with_slips(F.col("doc_id"), F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return group_variants(words.where((F.length("word") >= SHORTEST) & (F.col("n") >= LEAST)))


_H = crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")
ORACLE_SQL = {
    "op12_spelling_variants": f"""
WITH RECURSIVE {TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents
), hashed AS (
  SELECT run, k, {_H} AS h FROM (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL), crc_table
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2
), less AS (
  SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT less.word, words.word FROM less JOIN words ON rest = words.word
  UNION SELECT words.word, less.word FROM less JOIN words ON rest = words.word
), best AS (
  SELECT a, count(*) AS n_near, min({{'less': -n, 'word': b}}) AS m FROM near JOIN words ON b = words.word GROUP BY a
), found AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.less >= 10 * n THEN m.word END AS form, CASE WHEN -m.less >= 10 * n THEN -m.less END AS form_n
  FROM words LEFT JOIN best ON word = a
), chain AS (
  SELECT word, word AS root FROM found UNION ALL SELECT chain.word, found.form FROM chain JOIN found ON chain.root = found.word WHERE found.form IS NOT NULL
)
SELECT found.word, found.form, chain.root, found.n, found.n_near::BIGINT AS n_near, found.form_n::BIGINT AS form_n
FROM found JOIN chain USING (word) JOIN found AS last ON last.word = chain.root WHERE last.form IS NULL""",
}
