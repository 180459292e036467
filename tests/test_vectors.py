from pyspark.sql import functions as F

from lodestone.operators import vectors


def test_more_queries_than_a_block(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0], "x") for i in range(5)], "vec_id long, embedding array<double>, label string")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(30)], "query_id long, query_vec array<double>")
    whole = sorted(vectors.score_queries(rows, asked).collect())
    monkeypatch.setattr(vectors, "MAX_QUERIES", 7)
    assert sorted(vectors.score_queries(rows, asked).collect()) == whole and len(whole) == 150
    assert vectors.score_queries(rows, asked.limit(0)).count() == 0


def test_small_steps_lose_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0], f"g{i % 3}") for i in range(200)], "vec_id long, embedding array<double>, label string").repartition(3)
    asked = spark.createDataFrame([(i, [1.0, float(i % 4), 0.5]) for i in range(9)], "query_id long, query_vec array<double>")
    best = lambda **more: {tuple(r) for r in vectors.top_k(vectors.score_queries(rows, asked, k=6, **more), 6, "query_id", *more.values()).select("query_id", "id", "rank").collect()}
    near = lambda: {(r.id, r.query_id, r.score) for r in vectors.score_queries(rows, asked, nearest=True).collect()}
    every = vectors.score_queries(rows, asked)
    whole, grouped, nearest = best(), best(by="label"), near()
    assert whole == {tuple(r) for r in vectors.top_k(every, 6, "query_id").select("query_id", "id", "rank").collect()}
    assert grouped == {tuple(r) for r in vectors.top_k(every, 6, "query_id", "label").select("query_id", "id", "rank").collect()}
    assert nearest == {(r.id, r.query_id, r.score) for r in vectors.top_k(every.select(F.col("id").alias("v"), F.col("query_id").alias("id"), "score"), 1, "v").select(F.col("v").alias("id"), F.col("id").alias("query_id"), "score").collect()}
    assert len(nearest) == 200
    monkeypatch.setattr(vectors, "MAX_CELLS", 40)
    assert best() == whole and best(by="label") == grouped and near() == nearest


def test_a_task_gives_few_rows(spark):
    rows = spark.range(0, 30_000, 1, 2).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos(F.col("id") * 1.7), F.lit(0.3)).alias("embedding"))
    asked = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(100)], "query_id long, query_vec array<double>")
    assert vectors.score_queries(rows, asked, nearest=True).count() == 30_000
    assert vectors.score_queries(rows, asked, k=10).count() < 100 * 10 * 2 * 6


def test_lists_are_searched_without_rows_of_pairs(spark, monkeypatch):
    rows = spark.range(0, 600, 1, 3).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos(F.col("id") * 1.7), F.sin(F.col("id") * 0.3)).alias("embedding"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    monkeypatch.setattr(vectors, "cosine", None)  # no row for a vector and a query
    monkeypatch.setattr(vectors, "nearest_lists", lambda vector, centres, probes: F.array(F.lit(0), F.lit(1)) if probes > 1 else F.array((F.pmod(F.xxhash64(vector), F.lit(2))).cast("int")))
    found = {tuple(r) for r in vectors.ann_top_k(rows, asked, 5, lists=2, probes=2).select("query_id", "id", "rank").collect()}
    assert found == {tuple(r) for r in vectors.top_k(vectors.score_queries(rows, asked), 5, "query_id").select("query_id", "id", "rank").collect()}


def test_greedy_in_ranges_is_one_walk(spark, monkeypatch):
    import random

    draw = random.Random(3)
    rows = [(i * 3, None if i % 50 == 7 else [draw.gauss(0, 1) for _ in range(5 if i % 9 else 4)]) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, [1.0, 0.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>").repartition(3)
    pairs = {(r.a, r.b) for r in vectors.similar_pairs(df.where("vec_id IS NOT NULL"), 0.6).collect()}
    kept = []
    for i, v in rows:
        if v is None or not any((k, i) in pairs for k in kept):
            kept.append(i)
    monkeypatch.setattr(vectors, "FIRST", 20)
    met, whole = [], vectors.similar_pairs
    monkeypatch.setattr(vectors, "similar_pairs", lambda new, t: met.append(new.count()) or whole(new, t))
    got = [r.vec_id for r in vectors.greedy_distinct(df, 0.6).collect()]
    assert sorted(x for x in got if x is not None) == sorted(kept) and got.count(None) == 1
    assert len(met) > 3 and sum(met) < 290 and len(kept) < 200
