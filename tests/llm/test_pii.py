import random
import string
from itertools import product

import regex
from pyspark.sql import functions as F

from lodestone.llm import pii

FIND = regex.compile(pii.PATTERN.replace(r"\p{IsLatin}", r"\p{Latin}"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def shape(text):
    return regex.sub(r"\d", "0", text)


TEXTS = [
    (1, "Mail und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM, call +1 (974) 555-3436."),
    (2, "Card 4111 1111 1111 1111, 9807915762804495 and 97.51.17.173; ssn 123-45-6789."),
    (3, "Frau Anna Schmidt met Mr. Jones and Mr. Jones; Mrs. Jones wrote to élle.5@mail1.example.com"),
    (4, "IBAN DE89 3704 0044 0532 0130 00 and +19745553436 again; Herr Иван Петров"),
    (5, None), (6, ""), (7, "plain words 12 and 2024-01-02, a@b"), (None, "x.1@mail2.example.com"), (1, "Mail und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM, call +1 (974) 555-3436."),
    (8, "word " * 40000 + "und.34@mail7.example.com"),
]


def test_replacement(spark):
    df = spark.createDataFrame([(a, b, "s") for a, b in TEXTS], "doc_id long, text string, `__x` string")
    out = pii.replace_entities(df, "key")
    assert out.columns == [*df.columns, "pii_counts"]
    after = {}
    got = {(r.doc_id, len(r.text or "")): r for r in out.collect()}
    assert sum(1 for _ in got) <= len(TEXTS)
    rows = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    src = sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0))
    for r, (doc_id, text) in zip(rows, src):
        assert r.doc_id == doc_id
        if not text:
            assert r.text == text
            continue
        found = FIND.findall(text)
        assert all(luhn(m) for m in found if regex.fullmatch(r"\d{16}", m))
        assert sum(r.pii_counts.values()) == len(found)
        # outside the entities nothing changes, inside everything does
        at = 0
        pieces = [*FIND.split(text), ""]
        for k, (piece, m) in enumerate(zip(pieces, [*found, ""])):
            assert r.text.startswith(piece, at)
            at += len(piece)
            nxt = pieces[k + 1]
            new = r.text[at : at + len(m)] if not m[:1].isupper() or "@" in m else None
            if m and new is not None and not regex.fullmatch(r"[\d.]+", m):
                after.setdefault(m.lower() if "@" in m else regex.sub(r"[^\d+]", "", m), set()).add(new.lower() if "@" in m else regex.sub(r"[^\d+]", "", new))
                assert new != m and shape(new.lower() if "@" not in m else "") == shape(m.lower() if "@" not in m else "")
                at += len(m)
            elif m:
                at = r.text.index(nxt, at) if nxt else len(r.text)
    assert all(len(v) == 1 for v in after.values()), after
    assert len({next(iter(v)) for v in after.values()}) == len(after)
    card = rows[2].text if rows[2].doc_id == 2 else next(r.text for r in rows if r.doc_id == 2)
    assert luhn(regex.sub(r"\D", "", regex.search(r"\d{4} \d{4} \d{4} \d{4}", card)[0]))
    names = next(r.text for r in rows if r.doc_id == 3)
    found = regex.search(r"Frau (\w+) (\w+) met Mr\. (\w+) and Mr\. (\w+); Mrs\. (\w+) wrote", names)
    assert found[1] in pii.GIVEN_F and found[3] == found[4] != found[5] and "Jones" not in names
    assert regex.search(r"Herr \p{Cyrillic}+ \p{Cyrillic}+$", next(r.text for r in rows if r.doc_id == 4))


def mod97(account):
    account = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def test_numbers_that_are_no_cards_stay(spark):
    texts = ["Order 4111111111111112 shipped", "rows " + " ".join(map(str, range(1, 14))) + " end", "1 " * 9000, "4111-1111-1111-1112", "9" * 25, "1704067200000 ms"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace_entities(df, "k").collect()}
    assert all(out[i].text == t and out[i].pii_counts["card"] == 0 for i, t in enumerate(texts))


def test_cards_beside_other_numbers(spark):
    rows = [(1, "7 4111111111111111 99"), (2, "pay 4111 1111 1111 1111 by 12-34"), (3, "3782-822463-10005, 6011000990139424")]
    out = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert [out[i].pii_counts["card"] for i in (1, 2, 3)] == [1, 1, 2]
    assert all(luhn(regex.sub(r"\D", "", m)) for r in out.values() for m in regex.findall(r"\d{4}[\d -]{9,}\d{4,5}(?=\D|$)", r.text) if len(regex.sub(r"\D", "", m)) in (15, 16))
    assert regex.fullmatch(r"7 \d{16} 99", out[1].text) and "4111" not in out[2].text and out[2].text.endswith(" by 12-34")


def test_accounts_keep_country_and_check_digits(spark):
    accounts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606", "XX00 1234 5678 9012"]
    df = spark.createDataFrame([(i, f"to {a} now") for i, a in enumerate(accounts)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replace_entities(df, "k").collect()}
    for i, a in enumerate(accounts):
        new = regex.fullmatch(r"to (.*) now", out[i])[1]
        assert new != a and new[:2] == a[:2] and regex.sub("[A-Z]", "A", regex.sub(r"\d", "0", new)) == regex.sub("[A-Z]", "A", regex.sub(r"\d", "0", a))
        assert mod97(new) == 1 or mod97(a) != 1


def test_names_end_before_days_and_months(spark):
    rows = [(1, "Frau Keller Montag frei"), (2, "Mr Smith May come"), (3, "Mrs May Monday")]
    out = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert regex.fullmatch(r"Frau \w+ Montag frei", out[1]) and regex.fullmatch(r"Mr \w+ May come", out[2]) and regex.fullmatch(r"Mrs \w+ Monday", out[3])
    assert "Keller" not in out[1] and "Smith" not in out[2] and not out[3].startswith("Mrs May")


def test_collisions_are_drawn_anew(spark, monkeypatch):
    monkeypatch.setattr(pii, "SYLLABLES", ("ba", "be"))
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("abcdefgh") for _ in range(6)).title() for _ in range(7)})
    df = spark.createDataFrame([(i, f"Mr. {n} and Mr. {n}") for i, n in enumerate(names)], "doc_id long, text string")
    out = [r.text for r in pii.replace_entities(df, "k").orderBy("doc_id").collect()]
    pairs = [regex.fullmatch(r"Mr\. (\w+) and Mr\. (\w+)", t) for t in out]
    assert all(p[1] == p[2] for p in pairs) and len({p[1] for p in pairs}) == len(names)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.replace_entities(df, "k").collect() == []
    assert pii.replace_entities(df, "k").select(F.col("text")).columns == ["text"]


def test_whole_names_are_taken(spark):
    names = ["Mrs Anna Maria Schmidt", "Dr Anna Meyer-Landrut", "Dr 王小明", "Herr von der Leyen", "Prof. Dr. Ludwig van Beethoven", "Mr. J. R. Tolkien-Smith", "Dr محمد علي",
             "Sr Juan  Carlos de la Cruz", "Mr Jean-Luc d'Arc"]
    df = spark.createDataFrame([(i, f"today {n}, as said") for i, n in enumerate(names)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace_entities(df, "k").collect()}
    for i, n in enumerate(names):
        assert out[i].pii_counts["person"] == 1, n
        left = regex.findall(r"\p{L}{2,}", n)
        title = regex.match(rf"(?:{pii.TITLES} +)+", n)[0]
        assert out[i].text.startswith("today " + title) and out[i].text.endswith(", as said")
        assert not {w for w in left if w not in title} & set(regex.findall(r"\p{L}{2,}", out[i].text)), out[i].text
    assert regex.fullmatch(r"today Dr \p{Han}{3}, as said", out[2].text)
    many = spark.createDataFrame([(1, "Mr " + "Anna " * 20000)], "doc_id long, text string")
    assert "Anna Anna" not in pii.replace_entities(many, "k").first().text


def test_names_beyond_the_first_space(spark, monkeypatch):
    monkeypatch.setattr(pii, "SYLLABLES", ("ba", "be"))
    letters = "abcdefghij"
    names = [f"{a}{b}x".title() for a in letters for b in letters]
    text = " and ".join(f"Mr {n}" for n in names)
    han = " and ".join(f"Dr {a}{b}" for a in "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未" for b in "东南西北春夏秋冬金木水火土日月星")
    df = spark.createDataFrame([(1, text), (2, han)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replace_entities(df, "k").collect()}
    for i, n in ((1, len(names)), (2, 18 * 16)):
        new = regex.findall(r"(?:Mr|Dr) (\w+)", out[i])
        assert len(new) == len(set(new)) == n


def test_long_repetitions_stay_within_the_stack(spark):
    """Texts of a megabyte that a matcher could recurse on; with them one address each."""
    runs = ["a@" + "b." * 500_000, "Dr " * 300_000, "Mr " + "Anna-" * 200_000, "+1" + " 22" * 30_000, "1." * 500_000, "a" * 10**6, "@" * 10**6, "x@y" * 300_000]
    df = spark.createDataFrame([(i, f"{r} ! und.34@mail7.example.com") for i, r in enumerate(runs)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace_entities(df, "k").collect()}
    assert len(out) == len(runs)
    for i, r in out.items():
        assert r.pii_counts["email"] >= 1 and "und.34@mail7" not in r.text and r.text.endswith(".com"), i


def test_a_person_is_the_same_under_every_title(spark):
    rows = [(1, "Dr Anna Keller, said Frau Anna Keller"), (2, "Prof. Anna Keller"), (3, "Herr Kim Lee and Frau Kim Lee and Dr Kim Lee"), (4, "Frau Dr Anna Keller"), (5, "Dr Max Beck")]
    out = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    anna = regex.fullmatch(r"Dr (\w+ \w+), said Frau (\w+ \w+)", out[1])
    assert anna[1] == anna[2] and anna[1].split()[0] in pii.GIVEN_F
    assert out[2] == f"Prof. {anna[1]}" and out[4] == f"Frau Dr {anna[1]}"
    kim = regex.fullmatch(r"Herr (\w+ \w+) and Frau (\w+ \w+) and Dr (\w+ \w+)", out[3])
    assert len({kim[1], kim[2], kim[3]}) == 3 and kim[1].split()[0] in pii.GIVEN_M
    assert regex.fullmatch(r"Dr \w+ \w+", out[5]) and "Beck" not in out[5]


def test_no_kind_runs_out(spark):
    """All short addresses, 40,000 family names and many numbers of one short form are taken; all get others."""
    mails = [f"{a}@{b}.co" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    letters = "abcdefghijklmnopqrst"
    names = ["".join(x).title() for x in product(letters, letters, letters, "abcde")]
    phones = [f"+1 {a:02d} {b:02d}" for a in range(40) for b in range(100)]
    kinds = [mails, [f"Mr {n}" for n in names], phones]
    rows = [(i * 1000 + k // 100, " ; ".join(part[k : k + 100])) for i, part in enumerate(kinds) for k in range(0, len(part), 100)]
    out = {r.doc_id: r.text.split(" ; ") for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "k").collect()}
    for i, before in enumerate(kinds):
        after = [x for d in sorted(out) if d // 1000 == i for x in out[d]]
        assert len(after) == len(before) == len(set(after))
        assert not set(after) & set(before)
