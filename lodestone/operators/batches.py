"""Calls to a model in batches, with errors kept by row; the model itself is passed in."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_batch(df: DataFrame, text_col: str, model: Callable[[list[str]], list[str]], size: int = 10) -> DataFrame:
    """``df`` with ``reply`` and ``error``: ``model`` is called on lists of at most ``size`` texts.

    Where a list fails, its texts are tried one by one, so that an error marks only its own
    row. A null text gives neither reply nor error and isn't sent.
    """

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return model([text])[0], None
        except Exception as failed:  # a model may raise anything; the row says so
            return None, f"{type(failed).__name__}: {failed}"

    @F.arrow_udf("reply string, error string")
    def call(texts: pa.Array) -> pa.Array:
        own = texts.to_pylist()
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(own)
        sent = [i for i, t in enumerate(own) if t is not None]
        for at in range(0, len(sent), size):
            part = sent[at : at + size]
            try:
                made = [(r, None) for r in model([own[i] for i in part])]
                if len(made) != len(part):
                    raise ValueError("replies and texts differ in number")
            except Exception:
                made = [one(own[i]) for i in part]
            for i, m in zip(part, made):
                out[i] = m
        return pa.array([{"reply": r, "error": e} for r, e in out], pa.struct([("reply", pa.string()), ("error", pa.string())]))

    return df.withColumn("__r", call(text_col)).select(*[f"`{c}`" for c in df.columns if c not in ("reply", "error")], "__r.reply", "__r.error")
