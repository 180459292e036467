import random
from itertools import combinations

import duckdb
from lodestone.llm import spelling

import __spark_entry__ as entry


def edits(a, b):
    """Whether exactly one inserted, deleted or replaced code point makes a of b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words, times=10):
    near = {w: set() for w in words}
    for a, b in combinations(words, 2):
        if edits(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            form[w] = best if words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form.get(root) is not None:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if form.get(w) is not None else None))
    return sorted(out)


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_against_all_pairs(spark):
    """Words of any characters and lengths, dense neighbourhoods, ties, chains of forms."""
    rng = random.Random(1)
    letters = "abcdeéß×÷jq😀1"
    words = {}
    for _ in range(40):
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 12)))
        for _ in range(8):
            i = rng.randrange(len(base) + 1)
            c = rng.choice(letters)
            words[rng.choice([base[:i] + c + base[i:], base[:i] + base[i + 1 :], base[:i] + c + base[i + 1 :]])] = rng.choice([1, 2, 10, 20, 100, 1000])
    assert got(spelling.group_variants(table(spark, words))) == brute(words)
    assert got(spelling.group_variants(table(spark, words), times=2)) == brute(words, 2)


def test_one_letter_words_and_long_ones(spark):
    words = {"": 500, "a": 50, "b": 5, "ab": 1, "x" * 3000: 2, "x" * 3001: 30, "x" * 1500 + "y" + "x" * 1499: 3}
    assert got(spelling.group_variants(table(spark, words))) == brute(words)


def test_hot_neighbourhood(spark):
    """A thousand words that all share bands and halves with one another."""
    words = {f"variant{a}{b}{c}": 2 for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"} | {"variant": 10**6}
    assert got(spelling.group_variants(table(spark, words))) == brute(words)


def test_odd_rows_against_sql(spark, tmp_path):
    """Null and empty texts, a null id, repeated rows, very long runs, another column named word."""
    rng = random.Random(2)
    stems = ["handling", "Éclairage", "straßenbahn", "quickly", "reading×s", "n" * 300]
    rows = [(rng.choice([None, i]), " ".join(rng.choice(stems) for _ in range(rng.randrange(60))), "w") for i in range(200)]
    rows += [(1, None, "w"), (2, "", None), *rows[:30], (3, "a-b_c 12 " * 500, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(spelling.ORACLE_SQL["op12_spelling_variants"]).fetchall()
    found = got(entry.queries()["op12_spelling_variants"](spark, str(tmp_path)))
    assert found == sorted(want) and any(r[1] for r in found)


def test_no_words(spark):
    assert spelling.group_variants(spark.createDataFrame([(None, 5)], "word string, n long")).collect() == []
