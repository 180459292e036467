"""Text expressions shared by the retrieval operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of letters, digits and underscores of any script; Java's \w is ASCII only.
WORD = r"[\p{L}\p{N}_]+"
#: One code point of the unified Han block.
HAN = r"[\x{4e00}-\x{9fff}]"


def words(text: Column) -> Column:
    """Lower-cased words in order; null text gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def index_terms(text: Column) -> Column:
    """Terms of the inverted index: words, without single ASCII letters or digits.

    A run made of Han characters alone is cut into characters; a mixed run stays whole.
    """
    plain = F.filter(words(text), lambda t: F.length(t) > 1)
    cut = F.transform(
        words(text),
        lambda w: F.when(w.rlike(rf"^{HAN}+$"), F.filter(F.split(w, ""), lambda c: c != "")).otherwise(F.array(w)),
    )
    return F.when(text.rlike(HAN), F.filter(F.flatten(cut), lambda t: (F.length(t) > 1) | t.rlike(HAN))).otherwise(plain)
