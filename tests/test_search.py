"""Searches and dictionaries beyond one pass, and odd rows."""

from pyspark.sql import functions as F

from lodestone.operators import bm25, moderation, neartext, stores, vectors


def test_vectors_without_a_score_or_a_norm(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0, 5.0]), (5, [0.6, 0.8]), (6, [None, 2.0]), (7, [])]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, None), (13, [3.0, 0.0, 15.0])], "query_id long, query_vec array<double>")
    want = {(10, 1): 1.0, (10, 2): 0.0, (10, 4): 0.0, (10, 5): 0.6, (10, 6): 0.0, (10, 7): 0.0, (11, 1): 0.0, (11, 2): 0.0, (11, 4): 0.0, (11, 5): 0.8, (11, 6): 1.0, (11, 7): 0.0,
            (13, 1): 0.0, (13, 2): 0.0, (13, 5): 0.0, (13, 6): 0.0, (13, 7): 0.0}
    for most in (10_000, 2):
        monkeypatch.setattr(vectors, "MAX_QUERIES", most)
        found = vectors.score_queries(own, asked).collect()
        got = {(r.query_id, r.id): r.score for r in found}
        assert {k: got[k] for k in want} == want and len(found) == 18 and abs(got[13, 4] - 0.993884) < 0.01
    best = vectors.top_k(vectors.score_queries(own, asked.where("query_id = 10"), k=2), 2, "query_id").collect()
    assert sorted((r["rank"], r.id) for r in best) == [(1, 1), (2, 5)]
    assert vectors.score_queries(own.limit(0), asked).collect() == [] and vectors.score_queries(own, asked.limit(0)).collect() == []
    assert {(r.a, r.b) for r in vectors.similar_pairs(own, 0.5).collect()} == {(1, 5), (5, 6)}


def test_repeated_terms_and_many_terms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, None), (4, "alpha " * 30), (5, "日本 alpha")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "alpha alpha"), (3, "beta gamma alpha"), (4, "")], "query_id long, query string")
    found = {(r.query_id, r.id): r.score for r in bm25.bm25_search(docs, asked).collect()}
    assert all(abs(found[2, i] - 2 * found[1, i]) < 2e-6 for i in (1, 2, 4, 5)) and not [k for k in found if k[0] == 4 or k[1] == 3]
    assert {(r.query_id, r.id): r.score for r in bm25.bm25_search(docs, asked, most=1).collect()} == found
    bm25.save_index(docs, str(tmp_path / "index"))
    assert {(r.query_id, r.id): r.score for r in bm25.search_index(spark, str(tmp_path / "index"), asked).collect()} == found
    assert {(r.query_id, r.id): r.score for r in bm25.search_index(spark, str(tmp_path / "index"), asked, most=1).collect()} == found


def test_dictionary_in_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "One two THREE"), (2, None), (3, "")], "doc_id long, text string")
    rules = spark.createDataFrame([(w, "c", "C2") for w in ("one", "Two", "three", "four")], "keyword string, category string, code string")
    whole = sorted((r.id, r.keyword) for r in moderation.detections(docs, rules).collect())
    assert whole == [(1, "Two"), (1, "one"), (1, "three")]
    monkeypatch.setattr(moderation, "KEYWORDS_PER_PASS", 2)
    assert sorted((r.id, r.keyword) for r in moderation.detections(docs, rules).collect()) == whole
    assert moderation.detections(docs, rules.limit(0)).collect() == []


def test_near_texts_against_all_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog near the old mill by the river every single morning of may".split()
    rows = [(i, " ".join(base[: 20 - i % 4] + [f"x{i}"] * (i % 3))) for i in range(12)] + [(20, None), (21, ""), (22, "日本語"), (23, "日本語"), (24, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {r.id: frozenset(r.set) for r in neartext.shingle_sets(docs).collect()}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    reps = sorted(i for s, i in least.items() if s)
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert {(r.a, r.b) for r in neartext.similar_texts(docs, 0.7).collect()} == want and len(want) > 5
    assert neartext.similar_texts(docs.limit(0), 0.7).collect() == []


def test_stores_bear_nulls_and_repeats(spark):
    kept = spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")
    new = spark.createDataFrame([("a", 5), ("b", 7), ("b", 6), (None, 9)], "k string, n int")
    assert [tuple(r) for r in stores.insert_absent(kept, new, "k", "n").collect()] == [("b", 6)]
    log = spark.createDataFrame([("u", 1, "set"), ("u", 2, "clear"), ("v", 1, "set"), ("v", 3, "set"), ("w", 1, "clear"), ("x", 1, None)], "k string, n int, op string")
    state = {r.k: r.turns for r in stores.sessions(log, "k", "n", F.col("op") == "clear", turns=F.count(F.lit(1))).collect()}
    assert state == {"v": 2, "x": 1}


def test_one_text_is_searched_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(i, "red" if i % 2 else "hen fox") for i in range(50)] + [(99, None)], "query_id long, query string")
    seen = []
    terms = bm25.query_terms
    monkeypatch.setattr(bm25, "query_terms", lambda searches: seen.append(searches.count()) or terms(searches))
    found = bm25.bm25_search(docs, asked, 5).collect()
    assert seen == [2] and len(found) == 100 and {r.query_id for r in found} == set(range(50))


def test_terms_are_counted_without_a_shuffle(spark, capsys):
    docs = spark.createDataFrame([(1, "red fox red"), (2, None), (3, ""), (4, "hen")], "doc_id long, text string")
    post = bm25.postings(docs)
    post.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert {tuple(r) for r in post.collect()} == {(1, "red", 2), (1, "fox", 1), (4, "hen", 1)}


def test_similar_sets_shuffle_prefixes_only(spark, monkeypatch):
    """Every pair is found with few buckets too, with ids that must be near, and of sets of words."""
    import random

    from pyspark.sql import functions as F

    from lodestone.operators import neartext

    draw = random.Random(2)
    base = [draw.sample(range(-400, 400), 30) for _ in range(12)]
    rows = [(i * 3, sorted(set(draw.sample(base[i % 12], 30 - i % 5) + draw.sample(range(400, 450), i % 4)))) for i in range(150)] + [(1, []), (2, [7])]
    alike = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = {(i, k): round(alike(x, y), 6) for i, x in rows for k, y in rows if i < k and x and y and alike(x, y) >= 0.7}
    near = {p: s for p, s in want.items() if p[1] - p[0] <= 60}
    sets = spark.createDataFrame(rows, "id long, set array<long>")
    words = sets.select("id", F.col("set").cast("array<string>").alias("set"))
    for buckets in (1 << 18, 5):
        monkeypatch.setattr(neartext, "BUCKETS", buckets)
        assert {(r.a, r.b): r.score for r in neartext.similar_sets(sets, 0.7).collect()} == want
        assert {(r.a, r.b): r.score for r in neartext.similar_sets(words, 0.7, within=60).collect()} == near
    assert 0 < len(near) < len(want)


def test_near_texts_keep_no_sets(spark, monkeypatch):
    """Whatever is kept or dealt has no set of a text in it, only codes; sizes of parts don't change what is found."""
    import random

    draw, kept = random.Random(4), []
    base = [[f"w{draw.randrange(3000)}" for _ in range(40)] for _ in range(6)]
    texts = [" ".join(base[i % 6][: 40 - i % 4] + [f"x{i % 50}"] * (i % 3)) for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (90, None), (91, "one"), (92, texts[3].upper())], "doc_id long, text string")
    settled = neartext.settled
    monkeypatch.setattr(neartext, "settled", lambda df: kept.append(df.schema) or settled(df))
    found = []
    for held, listed, verified, ids in ((1_000_000, 1_000_000, 2000, 1_000_000), (7, 5, 2, 0)):
        for name, size in zip(("HELD", "LISTED", "VERIFIED", "BROADCAST_IDS"), (held, listed, verified, ids)):
            monkeypatch.setattr(neartext, name, size)
        members, pairs = neartext.near_texts(docs, 0.85)
        found.append(({tuple(r) for r in members.collect()}, {tuple(r) for r in pairs.collect()}))
    assert found[0] == found[1] and len(found[0][1]) > 20 and (92, 3) in {m[:2] for m in found[0][0]}
    assert kept and not [f for schema in kept for f in schema if f.dataType.typeName() == "array"]
    exact, hashed = neartext.minhash_texts(docs, 0.85)
    assert {tuple(r) for r in exact.collect()} == {tuple(r) for r in hashed.collect()} == found[0][1]
