"""Small column rules that the registered plans share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = r"[^\x{4e00}-\x{10ffff}]"


def token_estimate(text: Column) -> Column:
    """Two code points a token from U+4E00 on, four before; at least 1, and 0 for empty text."""
    wide = F.length(F.regexp_replace(text, WIDE, ""))
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(wide / 2.0 + (F.length(text) - wide) / 4.0))).cast("long")


def authority(source: Column) -> Column:
    """Weight of a source by the class that its name ends in."""
    return F.when(source.endswith("1"), 0.95).when(source.endswith("5"), 0.8).otherwise(0.5)
