"""Personal data: surrogates in DataFrame functions alone.

Entities are found by one pattern; a number in the form of a card is one only with a valid check
digit, and a name is only found behind a title. A surrogate follows from a key and the entity's normal
form alone, so the same entity has the same surrogate in every document (coreference)
without a join; a name with a title of no gender counts as the same person's whose titles tell
one. It keeps type, script, case, separators and length, a card's and an account's valid check
digits, an account's country and a title's gender; a name of several words gets a given and a
family name. After a title all name words, initials, particles and hyphens are taken up to a
weekday or month, also a capitalised word that is no name, and in scripts without case the
run of letters (with up to two more in Arabic, Hebrew and Devanagari). The distinct entities, grouped before anything else, are checked for
surrogates that collide with each other or with a real entity; those are drawn anew until
none is left, and only they and the names whose gender another place told are joined to their
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.names import fresh
from lodestone.sources.shared import settled

TITLES_M, TITLES_F = "Mr|Herr|Monsieur|Señor|Sr", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra"
TITLES = rf"(?:{TITLES_F}|{TITLES_M}|Dr|Prof)\b\.?"
#: A name word or initial; words that stand between or before them; a run in a script without case, and more such where blanks part them.
NAME = r"(?:\p{Lu}[\p{L}\p{M}'’]+|\p{Lu}\.)"
PARTICLES = r"(?:(?:von|vom|van|vander|de|del|della|der|den|des|di|da|das|do|dos|du|la|las|le|los|zu|zum|zur|ter|ten|bin|ibn|al|el|af|av|y|e)(?: +|-)|[dlD]['’])"
CASELESS = r"\p{Lo}[\p{Lo}\p{Lm}\p{M}·・]*+(?: [\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}]++){0,2}+"
EDGE, AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: In order: the first that fits at a place is taken.
#: Repeated groups are bounded or possessive: Java's matcher would recurse for each repetition. A domain has at most 127 labels.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.){1,126}\p{L}{2,}"
IP = r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}" + AFTER
IBAN = EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + AFTER
SSN = EDGE + r"\d{3}-\d{2}-\d{4}" + AFTER
PHONE = (
    r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})" + AFTER
)
#: Digits without a break, or in groups as cards have them.
CARD = EDGE + "(?:" + "|".join([r"\d{13,19}", *(rf"\d{{4}}(?:{s}\d{{4}}){{2}}{s}\d{{1,4}}(?:{s}\d{{1,3}})?|\d{{4}}{s}\d{{6}}{s}\d{{4,5}}" for s in " -")]) + ")" + AFTER
#: Words that end a name, where they aren't its first.
ENDS = ("Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December|"
        "Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember")  # fmt: skip
PERSON = EDGE + rf"(?:{TITLES} ++){{1,8}}(?:{PARTICLES}*+{NAME}(?:(?: +|-)(?!(?:{ENDS})\b){PARTICLES}*+{NAME})*+|{CASELESS})"
PATTERN = "|".join((EMAIL, IP, IBAN, SSN, PHONE, CARD, PERSON))
#: Texts without any of these hold no entity; it is far cheaper to look for.
HINT = rf"[0-9@]|{TITLES}"
TYPES = ("email", "ip", "iban", "ssn", "phone", "card", "person")
#: Kind of what has an entity's form and isn't one; it stays.
NONE = "none"

#: Given names by gender, and syllables that family names are made of.
GIVEN_M = ("Adam", "Boris", "Carl", "David", "Emil", "Frank", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Louis", "Martin", "Nils", "Oscar", "Paul")
GIVEN_F = ("Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karen", "Laura", "Maria", "Nora", "Olga", "Paula")
GIVEN_N = ("Alex", "Ariel", "Chris", "Dana", "Eden", "Jamie", "Jordan", "Kim", "Lee", "Morgan", "Noor", "Quinn", "Robin", "Sam", "Sasha", "Toni")
SYLLABLES = ("ba", "be", "bor", "da", "del", "dor", "fa", "fen", "gar", "go", "hal", "ho", "ka", "kel", "kor", "la",
             "len", "lo", "ma", "mer", "mon", "na", "nel", "no", "par", "ra", "ren", "ro", "sa", "tel", "va", "wen")
ALPHABETS = (("Cyrillic", "абвгдежзиклмнопрстуфхцчш"), ("Greek", "αβγδεζηθικλμνξοπρστυφχψω"), ("Han", "王李张刘陈杨黄赵吴周徐孙马朱胡林"),
             ("Arabic", "ابتجحدرسشعفقكلمنهوي"), ("Hebrew", "אבגדהוזחטילמנסעפקרש"), ("Hiragana", "あいうえおかきくけこさしすせそ"),
             ("Katakana", "アイウエオカキクケコサシスセソ"), ("Hangul", "김이박최정강조윤장임한오서신권"), ("Devanagari", "कखगचजटडतदनपबमरलवसह"))
ACCENTED = "áàâäéèêëíìîïóòôöúùûüñç"
MAX_ATTEMPTS = 50


def _one(items: tuple | str, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), n % len(items) + 1)


def _type(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^\p{L}"), "person")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(_luhn(F.regexp_replace(m, "[^0-9]", "")) == 0, "card")
        .otherwise(NONE)
    )


def _norm(m: Column, kind: Column) -> Column:
    """What names the entity: e-mail and name in lower case, an address as it is, else letters and digits.

    Before a name stands the gender of its titles, n without one.
    """
    name = F.lower(F.regexp_replace(F.regexp_replace(m, rf"^(?:{TITLES} ++){{1,8}}", ""), " +", " "))
    gender = F.when(m.rlike(rf"^(?:{TITLES} ++){{0,7}}?(?:{TITLES_F})\b"), "f").when(m.rlike(rf"^(?:{TITLES} ++){{0,7}}?(?:{TITLES_M})\b"), "m").otherwise("n")
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "ip", m)
        .when(kind == "person", F.concat(gender, F.lit(" "), name))
        .when(kind == "phone", F.regexp_replace(m, "[^0-9+]", ""))
        .otherwise(F.regexp_replace(m, "[^A-Z0-9]", ""))
    )


def entities(text: Column) -> Column:
    """array of (m, kind, norm): entities in order of place, and what only has the form of one (kind none); null text has none."""
    text = F.coalesce(text, F.lit(""))
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    typed = F.transform(found, lambda m: F.struct(m.alias("m"), _type(m).alias("kind")))
    return F.transform(typed, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _norm(x["m"], x["kind"]).alias("norm")))


def _byte(digest: Column, at: Column) -> Column:
    """One of the 32 bytes of a hexadecimal digest, as int."""
    return F.conv(F.substring(digest, F.pmod(at, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))).otherwise(empty)


def _like(c: Column, b: Column) -> Column:
    """A character of the same class: digit, letter of the script and case; others stay."""
    out = F.when(c.between("0", "9"), (b % 10).cast("string"))
    out = out.when(c.between("a", "z"), F.char(b % 26 + 97)).when(c.between("A", "Z"), F.char(b % 26 + 65))
    for script, letters in ALPHABETS:
        out = out.when(c.rlike(rf"\p{{Is{script}}}"), F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1)))
    return out.when(c.rlike(r"\p{L}"), F.substring(F.lit(ACCENTED), b % len(ACCENTED) + 1, F.lit(1))).otherwise(c)


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10: 0 for a valid card number."""
    back = F.reverse(_chars(digits))
    doubled = F.transform(back, lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10


def _mod97(account: Column) -> Column:
    """Remainder of an account number by 97, its first four characters last and letters as 10 to 35: 1 for a valid one."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(turned), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def _with(structs: Column, name: str, fields: tuple[str, ...], made) -> Column:
    """Array of structs with one more field, computed once per element."""
    return F.transform(structs, lambda x: F.struct(*[x[f].alias(f) for f in fields], made(x).alias(name)))


def surrogates(found: Column, key: str, attempt) -> Column:
    """``found`` (m, kind, norm) with the surrogate's normal form ``s``.

    ``attempt`` gives the number of the draw from an element, 0 unless draws collided. A name
    grows by a syllable or letter with each draw, an e-mail address by a letter from the third
    and a telephone number by a digit from the sixth, so that there are always enough; social
    security, account and card numbers and addresses of four numbers have a fixed form, and their
    surrogates can run out (see :func:`collisions`).
    """
    fields = ("m", "kind", "norm")
    tried = _with(found, "a", fields, attempt)
    fields += ("a",)
    drawn = _with(tried, "h", fields, lambda x: F.sha2(F.concat_ws("|", F.lit(key), x["kind"], x["norm"], x["a"]), 256))
    fields += ("h",)

    def mapped(x: Column) -> Column:
        """Character by character, but for a mail's last domain label, a number's + and first digit and an account's country."""
        cut = F.when(x["kind"] == "email", F.length(F.regexp_extract(x["norm"], r"\.[^.]*$", 0))).otherwise(0)
        head = F.when(((x["kind"] == "phone") & x["norm"].startswith("+")) | (x["kind"] == "iban"), 2).otherwise(0)
        n = F.length(x["norm"])
        chars = F.transform(_chars(x["norm"]), lambda c, i: F.when((i < head) | (i >= n - cut), c).otherwise(_like(c, _byte(x["h"], i))))
        more = F.when(x["kind"] == "email", x["a"] - 2).when(x["kind"] == "phone", x["a"] - 5).otherwise(0)
        extra = lambda one: F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: one(_byte(x["h"], 31 - i))), "")).otherwise("")
        letters = F.when(x["kind"] == "email", extra(lambda b: F.char(b % 26 + 97))).otherwise("")
        digits = F.when(x["kind"] == "phone", extra(lambda b: (b % 10).cast("string"))).otherwise("")
        return F.concat(letters, F.array_join(chars, ""), digits)

    def named(x: Column) -> Column:
        given = F.when(x["norm"].startswith("m "), _one(GIVEN_M, _byte(x["h"], F.lit(0)))).when(
            x["norm"].startswith("f "), _one(GIVEN_F, _byte(x["h"], F.lit(0)))
        ).otherwise(_one(GIVEN_N, _byte(x["h"], F.lit(0))))
        family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), x["a"] + 3), lambda i: _one(SYLLABLES, _byte(x["h"], i))), ""))
        own = F.substring(x["norm"], F.lit(3), F.length(x["norm"]))
        latin = F.when(own.rlike("[ -]"), F.concat(given, F.regexp_extract(own, "[ -]", 0), family)).otherwise(family)
        longer = F.concat(_chars(own), F.array_repeat(F.regexp_extract(own, r"\p{L}(?=\P{L}*$)", 0), x["a"]))
        return F.when(own.rlike(r"^[\p{IsLatin}\p{M} .'’-]+$"), latin).otherwise(F.initcap(F.array_join(F.transform(longer, lambda c, i: _like(c, _byte(x["h"], i))), "")))

    octets = lambda x: F.concat_ws(".", *[(_byte(x["h"], F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    made = _with(drawn, "s", fields, lambda x: F.when(x["kind"] == "ip", octets(x)).when(x["kind"] == "person", named(x)).otherwise(mapped(x)))

    def checked(x: Column) -> Column:
        """A valid card or account number stays valid: its check digits are set anew."""
        body = F.concat(F.substring(x["s"], F.lit(1), F.length(x["s"]) - 1), F.lit("0"))
        digit = ((10 - _luhn(body)) % 10).cast("string")
        fixed = F.concat(F.substring(x["s"], F.lit(1), F.length(x["s"]) - 1), digit)
        country, account = F.substring(x["s"], F.lit(1), F.lit(2)), F.substring(x["s"], F.lit(5), F.length(x["s"]))
        check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
        return F.when((x["kind"] == "card"), fixed).when((x["kind"] == "iban") & (_mod97(F.when(x["kind"] == "iban", x["norm"]).otherwise("")) == 1), F.concat(country, check, account)).otherwise(x["s"])

    return F.transform(made, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["norm"].alias("norm"), checked(x).alias("s")))


def rendered(x: Column) -> Column:
    """The surrogate in the form of the place: its separators, case and title."""
    digits = F.regexp_replace(x["s"], "[^A-Z0-9]", "")

    def fill(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(x["m"], F.lit(1), i), "[^A-Z0-9]", ""))
        return F.when(c.rlike("[A-Z0-9]"), F.substring(digits, before + 1, F.lit(1))).otherwise(c)

    mail = F.when(x["m"] == F.upper(x["m"]), F.upper(x["s"])).otherwise(x["s"])
    title = F.regexp_extract(x["m"], rf"^(?:{TITLES} ++){{1,8}}", 0)
    name = F.when(F.substring(x["m"], F.length(title) + 1, F.length(x["m"])).rlike(r"^[^\p{Ll}]+$"), F.upper(x["s"])).otherwise(x["s"])
    return (
        F.when(x["kind"] == NONE, x["m"])
        .when(x["kind"] == "email", mail)
        .when(x["kind"] == "ip", x["s"])
        .when(x["kind"] == "person", F.concat(title, name))
        .otherwise(F.concat(F.array_join(F.transform(_chars(x["m"]), fill), ""), F.substring(digits, F.length(F.regexp_replace(x["m"], "[^A-Z0-9]", "")) + 1, F.length(digits))))
    )


def resolved(known: DataFrame) -> DataFrame:
    """(kind, norm, own) of the distinct entities; ``own`` is the norm whose surrogate they have.

    A name without a gender belongs to the one person of that name who has one, if there is one:
    Dr and Frau Anna Keller are the same.
    """
    person = F.col("kind") == "person"
    name = F.when(person, F.substring("norm", F.lit(3), F.length("norm")))
    marked = known.select("kind", "norm", name.alias("name"), F.when(person, F.substring("norm", 1, 1)).alias("g"))
    sexed = marked.where("g IN ('f', 'm')").groupBy("name").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo = hi")
    joined = marked.join(sexed.select(F.col("name").alias("other"), "lo"), (F.col("name") == F.col("other")) & (F.col("g") == "n"), "left")
    return joined.select("kind", "norm", F.when(F.col("lo").isNull(), F.col("norm")).otherwise(F.concat_ws(" ", "lo", "name")).alias("own"))


def collisions(known: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(kind, norm, own, attempt) of the distinct entities, attempts raised until surrogates are
    distinct and none is a real entity; and how many were raised or belong to another's norm.

    Draws go on as long as they help: only where :data:`MAX_ATTEMPTS` of them in a row leave as many
    collisions as before, as when a text holds most numbers that a fixed form has, is it an error.
    """
    every = settled(resolved(known.select("kind", "norm").distinct()))
    raised = every.where("own <> norm").count()
    known = settled(every.where("own = norm").select("kind", "norm", F.lit(0).alias("attempt")))
    fewest, idle = None, 0
    while idle < MAX_ATTEMPTS:
        one = F.array(F.struct(F.lit("").alias("m"), F.col("kind").alias("kind"), F.col("norm").alias("norm")))
        named = known.withColumn("s", F.lower(surrogates(one, key, lambda x: F.col("attempt"))[0]["s"]))
        twice = named.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("keep")).where("n > 1")
        clash = named.join(twice, ["kind", "s"]).where("norm <> keep").select("kind", "norm")
        own = F.when(F.col("kind") == "person", F.substring("norm", F.lit(3), F.length("norm"))).otherwise(F.lower("norm"))
        real = known.select("kind", own.alias("s")).distinct()
        clash = settled(clash.union(named.join(real, ["kind", "s"], "left_semi").select("kind", "norm")).distinct())
        n = clash.count()
        if not n:
            drawn = every.join(known.withColumnRenamed("norm", "own"), ["kind", "own"])
            return drawn.select("kind", "norm", "own", "attempt"), raised
        idle = 0 if fewest is None or n < fewest else idle + 1
        fewest = n if fewest is None else min(n, fewest)
        raised += n
        again = clash.withColumn("more", F.lit(1))
        known = settled(known.join(again, ["kind", "norm"], "left").select("kind", "norm", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")))
    raise RuntimeError(f"{fewest} surrogates still collide after {MAX_ATTEMPTS} draws that changed nothing")


def _number_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", out: str = "pii_counts") -> DataFrame:
    """``docs`` with every entity in ``text_col`` replaced, and ``out`` (kind to number).

    Null text stays null and has no counts; all other columns stay. Repeated rows get equal
    texts. The key must be kept secret where surrogates are to be unlinkable.
    """
    text = F.col(f"`{text_col}`")
    with_found = docs.select(entities(text).alias("f"))
    known = with_found.select(F.explode("f").alias("x")).select("x.kind", "x.norm").where(F.col("kind") != NONE)
    drawn, raised = collisions(known, key)
    here_key, spans, redraw, new = (fresh(docs, n) for n in ("__key", "__found", "__redrawn", "__new"))
    marked = docs.withColumn(spans, entities(text))
    if raised:
        redrawn = drawn.where("attempt > 0 OR own <> norm")
        here = docs.where(text.rlike(HINT)).select(F.sha2(text, 256).alias(here_key), F.explode(entities(text)).alias("x"))
        here = here.select(here_key, F.col("x.kind").alias("kind"), F.col("x.norm").alias("norm")).distinct().join(redrawn, ["kind", "norm"])
        entry = F.struct(F.concat_ws("|", "kind", "norm"), F.struct("attempt", "own"))
        maps = here.groupBy(here_key).agg(F.map_from_entries(F.collect_list(entry)).alias(redraw))  # entities of one text
        marked = marked.withColumn(here_key, F.sha2(text, 256)).join(maps, here_key, "left")
        known = lambda x: F.try_element_at(F.col(redraw), F.concat_ws("|", x["kind"], x["norm"]))
        attempt = lambda x: F.coalesce(known(x)["attempt"], F.lit(0))
        own = lambda x: F.coalesce(known(x)["own"], x["norm"])
        found = F.transform(spans, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), own(x).alias("norm"), attempt(x).alias("a")))
        made = surrogates(found, key, lambda x: x["a"])
    else:
        made = surrogates(F.col(spans), key, lambda x: F.lit(0))
    marked = marked.withColumn(new, F.transform(made, rendered))
    zipped = F.arrays_zip(F.split(text, PATTERN, -1).alias("p"), F.col(new).alias("n"))  # one piece more than entities
    joined = F.array_join(F.flatten(F.transform(zipped, lambda x: F.array(x["p"], F.coalesce(x["n"], F.lit(""))))), "")
    counts = F.map_from_arrays(F.array(*[F.lit(t) for t in TYPES]), F.array(*[_number_of(spans, t) for t in TYPES]))
    new_text = F.when(F.size(spans) > 0, joined).otherwise(text)
    keep = [new_text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != out]
    return marked.select(*keep, counts.alias(out))


#: Key of the registered query; a parameter elsewhere.
DEMO_KEY = "lodestone"


def op8_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates, and the number of entities of each kind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = replace_entities(docs, DEMO_KEY)
    return done.select("doc_id", "text", *[F.col("pii_counts")[t].cast("long").alias(f"n_{t}") for t in TYPES])
