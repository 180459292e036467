"""Moods, recall, what is due, repeats, places and crawls on cases made by hand."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.operators import recall


def test_moods(spark):
    rows = [("开心 累", "joy", 0.3, "活泼"), ("好累 真的累", "fatigue", 0.6, "关心"), (None, "neutral", 0.3, "normal"), ("", "neutral", 0.3, "normal"), ("WOW 太棒了 厉害 激动 兴奋", "excitement", 1.0, "共鸣"), ("担心", "fear", 0.3, "安慰")]
    got = spark.createDataFrame(rows, "t string, m string, i double, o string").select(recall.mood(F.col("t")).alias("r"), "m", "i", "o").collect()
    assert all((r.r.mood, r.r.intensity, r.r.tone) == (r.m, r.i, r.o) for r in got)
    codes = spark.createDataFrame([("drug",), (None,), ("hate",), ("x",)], "c string").select(recall.category_code(F.col("c")).alias("k")).collect()
    assert [r.k for r in codes] == ["C6", "C2", "C7", "C2"]


def test_memories(spark):
    asked = spark.createDataFrame([(1, 5, "上次 Anna", ["Anna", "Bo"]), (2, 5, "nothing", None), (3, 6, "最开始", []), (4, 7, "Anna", ["anna"])], "query_id long, user long, said string, entities array<string>")
    kept = spark.createDataFrame([(10, 5, "about ANNA and bo"), (11, 5, "other"), (12, 5, ""), (13, 5, None), (14, 6, "x"), (15, 7, "anna")], "session_id long, user long, summary string")
    got = {(r.query_id, r.session_id): (r.score, r.method, r.place) for r in recall.memories(asked, kept, 1).collect()}
    assert got == {(1, 10): (2 * 10 + 5 + 8 + 2 * 15, "keyword", 1), (3, 14): (6, "time", 1), (4, 15): (25, "keyword", 1)}


def test_due(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [(5, 0, None), (4, 199, None), (4, 200, None), (9, 900, now - timedelta(seconds=299)), (9, 900, now - timedelta(seconds=300))]
    df = spark.createDataFrame(rows, "turns int, chars int, done_at timestamp").withColumn("now", F.lit(now))
    assert [(r.summary_due, r.profile_due) for r in recall.due(df, F.col("now"), 5, 200, 300).collect()] == [(True, True), (False, False), (True, False), (False, False), (True, True)]


def test_repeats(spark):
    kept = spark.createDataFrame([(i, "a", f"w{i} one two three four five six seven eight") for i in range(9)] + [(50, "b", "")], "id long, layer string, text string")
    new = spark.createDataFrame([(1, "a", "w0 one two three four five six seven eight"), (2, "a", "W8 one two three four five six seven eight!"), (3, "a", "w1 one two three four five six seven eight more"), (4, "b", ""), (5, "c", "w0"), (6, "a", None), (7, None, "x"), (8, "a", "one two three four five six seven nine ten eleven")], "id long, layer string, text string")
    got = {r.id: r.duplicate for r in recall.repeats(new, kept, "layer", "text", "id").collect()}
    assert got == {1: "exact", 2: "similar", 3: None, 4: "exact", 5: None, 6: None, 7: None, 8: None}


def test_places_overlap(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("aAbB.é") for _ in range(rng.randrange(40)))) for i in range(40)] + [(99, None), (100, "")]
    patterns = ["aa", "aba", ".", "é", "b.", ""]
    got = sorted((r.id, r.pattern, r.place) for r in recall.places(spark.createDataFrame(rows, "id long, text string"), patterns, "id", "text").collect())
    want = sorted((i, p, m.start() + 1) for i, t in rows for p in patterns if p for m in re.finditer(f"(?={re.escape(p)})", (t or "").lower()))
    assert got == want


def test_crawl_is_directed_and_bounded(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), ("a", "a"), ("b", "a"), ("a", "e")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    assert [tuple(r) for r in recall.crawled(links, start, 2, 10).collect()] == [("a", 0), ("b", 1), ("e", 1), ("c", 2)]
    assert [tuple(r) for r in recall.crawled(links, start, 2, 3).collect()] == [("a", 0), ("b", 1), ("e", 1)]


def test_cosines_of_sentences(spark):
    rows = [(1, 0, "a b b"), (1, 1, "b a"), (1, 2, "..."), (1, 3, "b"), (2, 0, "x")]
    got = {r.doc: r.alike for r in recall.sentence_cosines(spark.createDataFrame(rows, "doc long, i int, text string"), "doc").collect()}
    assert got == {1: [None, round(3 / (5**0.5 * 2**0.5), 6), 0.0, 0.0], 2: [None]}


def test_names_end_at_letters_that_are_not_ascii(spark, tmp_path):
    from lodestone.plans import recall as plans

    said = [(0, 0, "user", "Seen by éAnna and Bertö, not xCarl"), (97 * 20, 0, "user", "anna bert carl")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {(r.query_id, r.session_id): r.score for r in plans.memories_recalled(spark, str(tmp_path)).collect()}
    assert found[0, 97 * 20] == 2 * 25 and found[0, 0] == 3 * 25


def test_sentences_are_compared_in_their_row(spark):
    rows = spark.createDataFrame([(1, ["A b b.", "b a!", "c", "", "c c"]), (2, []), (3, None), (4, ["x"])], "doc long, s array<string>")
    found = rows.select("doc", recall.neighbour_cosines(F.col("s")).alias("alike"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc: r.alike for r in found.collect()} == {1: [None, 0.948683, 0.0, 0.0, 0.0], 2: [], 3: None, 4: [None]}
