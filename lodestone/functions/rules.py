"""Rules over text: marks of reasoning, JSON inside text, language by script, inverted texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code point ranges that decide the language, first match wins.
SCRIPTS = [
    ("zh", "4e00", "9fff"), ("th", "0e00", "0e7f"), ("km", "1780", "17ff"), ("lo", "0e80", "0eff"),
    ("my", "1000", "109f"), ("ta", "0b80", "0bff"), ("ja", "3040", "30ff"), ("ko", "ac00", "d7af"),
]
#: Words that decide it after the scripts, first match wins; en without any.
GREETINGS = [
    ("id", "apa kabar", "indonesia"), ("ms", "apa khabar", "malaysia"), ("vi", "xin chào", "vietnam"),
    ("tl", "kamusta", "philippines"), ("en", "hello", "thank you", "world"), ("fr", "bonjour", "merci"),
    ("es", "hola", "gracias"), ("pt", "olá", "obrigado"), ("de", "hallo", "danke"), ("ru", "привет", "спасибо"),
]


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_thoughts(text: Column) -> Column:
    """Without ``<think>…</think>``, also over lines; null stays null."""
    return stripped(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def json_object(text: Column, schema: str, default: Column | None = None) -> Column:
    """The text between the first ``{`` and the last ``}`` as a struct, else ``default`` (null without one)."""
    raw = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    found = F.when(F.get_json_object(raw, "$").isNotNull(), F.from_json(raw, schema))
    return found if default is None else F.coalesce(found, default)


def language_of(text: Column) -> Column:
    """Language by script, then by greeting, then en; null for null."""
    low = F.lower(text)
    rules = [(lang, text.rlike(rf"[\x{{{a}}}-\x{{{b}}}]")) for lang, a, b in SCRIPTS]
    rules += [(lang, reduce(Column.__or__, [low.contains(w) for w in many])) for lang, *many in GREETINGS]
    return F.coalesce(*[F.when(hit, lang) for lang, hit in rules], F.when(text.isNotNull(), "en"))


def inverted(terms: Column) -> Column:
    """Map from each term of an array to its positions, from 0."""
    places = lambda t: F.filter(F.transform(terms, lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull())
    return F.map_from_entries(F.transform(F.array_distinct(terms), lambda t: F.struct(t, places(t))))


def rebuilt(index: Column) -> Column:
    """The text of an inverted index, by position; empty for an empty index."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def base_id(chunk_id: Column) -> Column:
    """Without the last ``_chunk_…`` suffix."""
    return F.regexp_replace(chunk_id, r"_chunk_(?!.*_chunk_).*$", "")


def composed(fields: list[tuple[str, Column]]) -> Column:
    """One line ``label：value`` for each field that has a value."""
    return F.concat_ws("\n", *[F.when(F.coalesce(F.length(v), F.lit(0)) > 0, F.concat(F.lit(f"{label}："), v)) for label, v in fields])


def labelled(text: Column, labels: list[str]) -> list[Column]:
    """The value after each label, null without the label.

    A value ends at the first of the labels listed after its own that occurs behind it.
    """
    out = []
    for i, label in enumerate(labels):
        mark = F.lit(f"{label}：")
        rest = F.substring(text, F.position(mark, text) + len(label) + 1, F.length(text))
        ends = [F.when(rest.contains(f"{k}："), F.substring_index(rest, f"{k}：", 1)) for k in labels[i + 1 :]]
        out.append(F.when(text.contains(f"{label}："), stripped(F.coalesce(*ends, rest))))
    return out


def reply_scores(reply: Column, expected: int) -> Column:
    """Scores of a model's reply, out of ten, as shares of one.

    From ``{"scores": […]}`` in the reply, missing ones 0.5; without such an object from its
    numbers, where a missing one counts 5.0.
    """
    raw = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    own = F.transform(F.coalesce(F.from_json(raw, "scores array<double>")["scores"], F.array().cast("array<double>")), lambda x: x / 10)
    numbers = F.transform(F.regexp_extract_all(reply, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double") / 10)
    pad = lambda scores, value: F.slice(F.concat(scores, F.array_repeat(F.lit(value), expected)), 1, expected)
    return F.when(F.get_json_object(raw, "$").isNotNull(), pad(own, 0.5)).otherwise(pad(numbers, 5.0))
