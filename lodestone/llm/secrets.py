"""Secret scan in DataFrame functions alone: patterns, and entropy over sliding windows.

Base kinds are patterns. The method adds spans: candidate strings are runs of at least 20
characters of a token alphabet; a window of 20 slides over each. The counts of its characters
and of its character classes are carried along and changed by the one character that leaves
and the one that comes, and with them the sum that gives the Shannon entropy. A window's class
(hex, letters of one case, mixed) sets its threshold, near what random windows of that alphabet
reach. Windows above it are joined to spans of one class, unless the candidate is on the
allow-list. All sums are of whole numbers (count times log2 of the count, in millionths), so
that results don't depend on the order of additions.
"""

from __future__ import annotations

from math import floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.names import fresh

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_one_case", "entropy_base64")

WINDOW, UNIT = 20, 1_000_000
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
#: Least entropy in bits of a window: of hex digits; of letters of one case with at least two digits; of both cases
#: with and without digits.
HEX_BITS, ONE_CASE_BITS, BASE64_BITS, LETTERS_BITS = 3.0, 3.7, 3.75, 4.0
LEAST_DIGITS = 2
#: Characters in the order of their codes from 1: digits to 10, lower case to 36 (hex to 16), upper case to 62 (hex to 42).
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"
#: Matches whose places are added up in one go, so that many of them cost no square.
RUN = 128
#: Words and numbers of up to eight digits that hyphens or underscores part.
_PART = r"(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,8}|[A-Za-z][0-9]{1,3})(?![A-Za-z0-9+/=])"
#: Candidates that are no secrets: one kind of letters only, parted words, UUIDs, examples, alphabets.
ALLOW = (
    r"^(?:[A-Z]+|[a-z]+|[0-9]+|[A-Z]?[a-z_-]+|[A-Z_-]+)$|^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
    rf"|^{_PART}(?:[-_]++{_PART})++$"
    r"|(?i:example|sample|placeholder|abcdefghij|0123456789abcdef|your[_-])"
)

_COST = [round(c * log2(c) * UNIT) if c else 0 for c in range(WINDOW + 2)]


def _most(bits: float) -> int:
    """Largest sum of count times log2 of count at which a window has that entropy."""
    return floor(WINDOW * (log2(WINDOW) - bits) * UNIT)


def _cost(count: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in _COST]), count + 1)


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str) -> Column:
    """Matches, leftmost and not overlapping, as array of (s, e, m): code points, end exclusive.

    A match's place follows from the lengths of the pieces between matches, added up by runs.
    """
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, pair: Column) -> Column:
        s = state["at"] + F.length(pair["p"])
        e = s + F.length(pair["m"])
        return F.struct(e.alias("at"), F.concat(state["out"], F.array(F.struct(s.alias("s"), e.alias("e"), pair["m"].alias("m")))).alias("out"))

    def placed(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(pairs, i * RUN + 1, RUN), start, step))
        return _let(runs, moved)

    def moved(runs: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(runs, zero, lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        shift = lambda r, o: F.transform(r["out"], lambda x: F.struct((x["s"] + o).alias("s"), (x["e"] + o).alias("e"), x["m"].alias("m")))
        return F.flatten(F.zip_with(runs, before, shift))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(matches.alias("m"), F.split(text, pattern, -1).alias("p")), lambda x: x["m"].isNotNull())
    return F.when(text.rlike(pattern), _let(pairs, placed)).otherwise(empty)


_NUMBERS = ("sum", "upper", "lower", "digits", "other")  # other: not a hex digit


def _moved(state: Column, code: Column, by: int) -> list[Column]:
    """Fields of the state with one character more (``by`` 1) or less (-1); counts are characters from A on."""
    count = F.ascii(F.substring(state["counts"], code, F.lit(1))) - 65
    one = lambda hit: F.when(hit, by).otherwise(0)
    return [
        (state["sum"] - _cost(count) + _cost(count + by)).cast("long").alias("sum"),
        F.overlay(state["counts"], F.char(count + 65 + by), code, F.lit(1)).alias("counts"),
        (state["upper"] + one(code.between(37, 62))).alias("upper"),
        (state["lower"] + one(code.between(11, 36))).alias("lower"),
        (state["digits"] + one(code <= 10)).alias("digits"),
        (state["other"] + one(~(code.between(1, 16) | code.between(37, 42)))).alias("other"),
    ]


def _flag(state: Column) -> Column:
    """Number of the kind that the window has enough entropy for; null without."""
    enough = lambda bits: state["sum"] <= _most(bits)
    one_case = (state["upper"] == 0) | (state["lower"] == 0)
    mixed = F.when(state["digits"] > 0, enough(BASE64_BITS)).otherwise(enough(LETTERS_BITS))
    return (
        F.when(state["other"] == 0, F.when(enough(HEX_BITS), 3))
        .when(one_case, F.when((state["digits"] >= LEAST_DIGITS) & enough(ONE_CASE_BITS), 4))
        .when(mixed, 5)
    )


_SPANS = "array<struct<s:int,k:int,e:int>>"


def _windows(text: Column) -> Column:
    """Spans (s, k, e) within a candidate covered by windows of enough entropy."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))

    def closed(state: Column) -> Column:
        """The finished spans and the one that is open."""
        span = F.struct(state["s"].alias("s"), state["k"].alias("k"), state["e"].alias("e"))
        return F.when(state["k"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(span)))

    def judged(old: Column, fields: list[Column], at: Column) -> Column:
        """State after the window that starts at ``at``: it lengthens the open span of its kind or opens a new one."""
        with_kind = lambda x: F.struct(*[x[n].alias(n) for n in (*_NUMBERS, "counts")], _flag(x).alias("kind"))

        def done(x: Column) -> Column:
            goes_on = (x["kind"] == old["k"]) & (old["e"] >= at)
            return F.struct(
                *[x[n].alias(n) for n in (*_NUMBERS, "counts")],
                F.when(x["kind"].isNull() | goes_on, old["s"]).otherwise(at).alias("s"),
                F.when(x["kind"].isNull(), old["k"]).otherwise(x["kind"]).alias("k"),
                F.when(x["kind"].isNull(), old["e"]).otherwise(at + WINDOW).alias("e"),
                F.when(x["kind"].isNull() | goes_on, old["out"]).otherwise(closed(old)).alias("out"),
            )

        return _let(_let(F.struct(*fields), with_kind), done)

    def over(c: Column) -> Column:
        zero = F.struct(*[F.lit(0).cast("long" if n == "sum" else "int").alias(n) for n in _NUMBERS], F.lit("A" * len(ALPHABET)).alias("counts"))
        order = lambda fields: F.struct(fields[0], *fields[2:], fields[1])  # noqa: E731  as in zero
        first = F.aggregate(F.slice(c, 1, WINDOW), zero, lambda st, x: order(_moved(st, x, 1)))
        none = F.struct(F.lit(0).alias("s"), F.lit(None).cast("int").alias("k"), F.lit(0).alias("e"), F.array().cast(_SPANS).alias("out"))
        begin = _let(first, lambda f: judged(none, [f[n].alias(n) for n in (*_NUMBERS, "counts")], F.lit(0)))

        def step(state: Column, at: Column) -> Column:
            gone, come = F.element_at(c, at), F.element_at(c, at + WINDOW)
            return _let(F.struct(*_moved(state, gone, -1)), lambda less: judged(state, _moved(less, come, 1), at))

        steps = F.when(F.size(c) > WINDOW, F.sequence(F.lit(1), F.size(c) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, begin, step, closed)

    return _let(codes, over)


def _kind(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e")))


def _entropy(text: Column) -> Column:
    """Spans (s, k, e) of the sliding windows over all candidates of a text."""
    kept = F.filter(found(text, CANDIDATE), lambda c: ~c["m"].rlike(ALLOW))

    def of(candidate: Column) -> Column:
        return F.transform(_windows(candidate["m"]), lambda w: F.struct((candidate["s"] + w["s"]).alias("s"), w["k"].alias("k"), (candidate["s"] + w["e"]).alias("e")))

    return F.flatten(F.transform(kept, of))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secret_base`` and ``secret_spans``: arrays of (s, k, e), sorted.

    ``k`` numbers :data:`KINDS`; base spans are those of the three patterns, and all spans
    hold them too. Null and empty texts have none. Spans of different kinds may overlap. Columns
    of these two names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], "^" + ASSIGN + "$", 2)) >= 12)
    base = F.concat(_kind(assign, 0), _kind(found(text, ACCESS), 1), _kind(found(text, HEX), 2))
    more = fresh(docs, "__entropy")
    with_base = docs.withColumn("secret_base", F.array_sort(base)).withColumn(more, _entropy(text))
    return with_base.withColumn("secret_spans", F.array_sort(F.concat("secret_base", more))).drop(more)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def number(kind: int) -> Column:
        return F.size(F.filter("secret_base", lambda x: x["k"] == kind)).cast("long")

    return scan(docs).select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_joined(F.col("secret_base")), 256).alias("base_sha256"),
        _joined(F.col("secret_spans")).alias("spans"),
    )
