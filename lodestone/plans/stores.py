"""Moderation in stages, blocked texts, caches, sessions, vector tables and unions of stores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import words
from lodestone.operators import moderation, neartext, stores, vectors
from lodestone.plans.corpus import _rules, moderation_details
from lodestone.plans.retrieval import _COS, _searches
from lodestone.session import ship
from lodestone.sources.shared import new_folder, settled
from lodestone.sources.tables import table

BLOCKED, KEYWORDS = ["worthless", "licensed", "Blend"], [("token", "r1"), ("der", "r2"), ("a", "r1"), ("licensed", "r9"), ("eau", "r2")]
CODES = [("r1", "C2"), ("r2", "C5")]
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _docs(s, d):
    return table(s, d, "documents")


def moderation_first_hit(s, d):
    """The blocked word that comes first in each text, and where, from 1; case kept."""
    return moderation.first_hits(_docs(s, d), BLOCKED)


def moderation_flags(s, d):
    """One flag a category, and whether any is raised, for every text."""
    found = moderation_details(s, d).groupBy("id").pivot("category", sorted({c for _, c, _ in moderation.RULES})).agg(F.count(F.lit(1)))
    names = [c for c in found.columns if c != "id"]
    every = _docs(s, d).select(F.col("doc_id").alias("id")).join(found, "id", "left")
    return every.select("id", *[F.col(c).isNotNull().alias(c) for c in names], F.coalesce(*names).isNotNull().alias("overall"))


def keyword_table(s, d):
    """Keywords of two characters or more whose class has a code."""
    found = s.createDataFrame(KEYWORDS, "keyword string, risk string").join(s.createDataFrame(CODES, "risk string, code string"), "risk")
    return found.where(F.length("keyword") >= 2)


def moderation_segmented(s, d):
    """Keywords that a text contains, or that are one of its words, and in which way."""
    rows = moderation.segmented(_docs(s, d), [r.keyword for r in keyword_table(s, d).collect()])  # a fixed list
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "keyword", "way"))), ",").alias("found"))


def moderation_staged(s, d):
    """The first stage that finds something, in the order of the codes: blocked words, categories, bank."""
    return moderation.staged(_docs(s, d).select("doc_id", "text", "lang"), BLOCKED, _rules(s), table(s, d, "benchmark"))


def moderation_batch(s, d):
    """Violations and passes by language; a text without a verdict passes."""
    return _docs(s, d).select("doc_id", "lang").join(moderation_staged(s, d), "doc_id", "left").groupBy("lang").agg(
        F.count_if(F.col("code").isNotNull()).alias("violations"), F.count_if(F.col("code").isNull()).alias("passes"))


def moderation_confidence(s, d):
    """Per text: number of categories and mean confidence of its detections, 0.95 from keywords, 0.85 from the bank."""
    found = moderation_details(s, d).select("id", "category", F.lit(0.95).alias("c")).distinct()
    bank = moderation.contained(_docs(s, d).select("doc_id", "text"), table(s, d, "benchmark")).select(F.col("doc_id").alias("id"), F.lit("bank").alias("category"), F.lit(0.85).alias("c")).distinct()
    return found.union(bank).groupBy("id").agg(F.countDistinct("category").alias("categories"), F.round(F.avg("c"), 6).alias("confidence"))


def _blocked(s, d):
    """Blocked texts written by code: those of even ids first, then the others whose text is not there yet; read again."""
    folder = new_folder(s, "blocked")
    found = _docs(s, d).select("doc_id", "text").join(moderation_staged(s, d), "doc_id").select("doc_id", "text", "code")
    stores.insert_absent(found.limit(0), found.where("doc_id % 2 = 0"), "text", "doc_id").write.partitionBy("code").parquet(folder)
    kept = s.read.parquet(folder)
    more = settled(stores.insert_absent(kept, found.where("doc_id % 2 = 1"), "text", "doc_id"))
    more.write.mode("append").partitionBy("code").parquet(folder)
    return s.read.schema("doc_id long, text string, code string").parquet(folder)


def blocked_store(s, d):
    return _blocked(s, d).select("doc_id", "code", F.md5("text").alias("digest"))


def blocked_stats(s, d):
    """Texts of each code, and the last ten ids with 50 characters."""
    kept = settled(_blocked(s, d))
    last = kept.orderBy(F.desc("doc_id")).limit(10).select(F.lit("last").alias("kind"), F.substring("text", 1, 50).alias("what"), F.col("doc_id").alias("n"))
    return kept.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select(F.lit("code").alias("kind"), F.col("code").alias("what"), "n").union(last)


def candidates_approved(s, d):
    """Candidates at the given places marked as approved, and both kinds counted by event."""
    seen = table(s, d, "events").groupBy("event_type", "user_id").agg(F.max("value").alias("best"))
    placed = seen.withColumn("place", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("best"), "user_id")))
    return placed.groupBy("event_type").agg(F.count_if(F.col("place").isin(1, 3, 5)).alias("approved"), F.count_if(~F.col("place").isin(1, 3, 5)).alias("pending"))


def candidates_merged(s, d):
    """A bank of labels with the approved, often reviewed and similar candidates appended once."""
    bank = table(s, d, "part").select(F.col("p_brand").alias("text")).distinct()
    new = table(s, d, "part").groupBy(F.col("p_type").alias("text")).agg(F.count(F.lit(1)).alias("reviews"), F.max(F.col("p_size") / 50).alias("similarity")).where("reviews >= 5 AND similarity >= 0.9")
    return bank.withColumn("source", F.lit("bank")).union(new.select("text", F.lit("candidate")))


def cache_similar_hits(s, d):
    """Texts asked in the order of ids, ten seconds apart: the last one within an hour whose words are 0.8 alike."""
    own = _docs(s, d).select(F.col("doc_id").alias("id"), F.array_sort(F.array_distinct(words(F.col("text")))).alias("set"))
    found = neartext.similar_sets(own, 0.8, within=360)
    return found.groupBy("b").agg(F.max(F.struct("a", "score")).alias("r")).select(F.col("b").alias("doc_id"), F.col("r.a").alias("hit"), F.col("r.score").alias("score"))


def cache_lru(s, d):
    return stores.lru(table(s, d, "events").select(F.concat_ws("/", "user_id", "event_type").alias("key"), "event_id"), "key", "event_id", 100)


def cache_levels(s, d):
    """Items looked up among documents by whole text, by their words, by their sentences; the first level that hits."""
    keys = {"text": lambda c: F.md5(c), "words": lambda c: F.md5(F.array_join(F.array_sort(F.array_distinct(words(c))), "|")),
            "sentences": lambda c: F.md5(F.array_join(F.array_sort(F.array_distinct(F.split(c, r"[.!?]\s*"))), "|"))}
    kept = _docs(s, d).select("doc_id", *[k(F.col("text")).alias(n) for n, k in keys.items()])
    asked = _docs(s, d).where("doc_id % 3 = 0").select("doc_id", *[k(F.when(F.col("doc_id") % 2 == 0, F.translate("text", LOWER, LOWER.upper())).otherwise(F.concat("text", F.lit(" ")))).alias(n) for n, k in keys.items()])
    for name in keys:
        level = kept.groupBy(name).agg(F.min("doc_id").alias(f"by_{name}"))
        asked = asked.join(level, name, "left")
    level = F.coalesce(*[F.when(F.col(f"by_{n}").isNotNull(), n) for n in keys])
    return asked.select("doc_id", level.alias("level"), F.coalesce(*[f"by_{n}" for n in keys]).alias("hit"))


def session_state(s, d):
    """Each user's state after the last event that clears it."""
    events = table(s, d, "events").select("event_id", "user_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return stores.sessions(events, "user_id", "event_id", F.col("event_type") == "error", turns=F.count(F.lit(1)), total=F.round(F.sum("value"), 4), updated=F.max("at"))


def log_keep_last(s, d):
    return stores.keep_last(table(s, d, "events").select("event_type", "event_id"), "event_type", ["event_id"], 50)


def store_precedence(s, d):
    """Three stores by name; a later one's row wins."""
    own = [table(s, d, t).select(F.substring(c, 1, n).alias("name"), F.lit(t).alias("store"), F.col(k).cast("long").alias("id")) for t, c, k, n in (("part", "p_name", "p_partkey", 4), ("nation", "n_name", "n_nationkey", 4), ("region", "r_name", "r_regionkey", 4))]
    return stores.by_precedence([o.groupBy("name", "store").agg(F.max("id").alias("id")) for o in own], "name")


def store_upsert(s, d):
    """A written table with new prices for every seventh and ten new keys; creation times stay."""
    folder = new_folder(s, "upsert")
    table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(1).alias("created"), F.lit(1).alias("updated")).write.parquet(folder)
    new = table(s, d, "orders").where("o_orderkey % 7 = 0").select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("price")).union(s.range(10).select((-F.col("id") - 1).alias("o_orderkey"), F.lit(0.5)))
    merged = stores.upsert(s.read.parquet(folder), new.withColumn("created", F.lit(2)).withColumn("updated", F.lit(2)), "o_orderkey")
    merged.write.parquet(f"{folder}-next")
    return s.read.parquet(f"{folder}-next")


def guarded_insert(s, d):
    """Documents of even ids are kept; the others go in if their text is new and their score reaches the layer's bar."""
    own = _docs(s, d).join(table(s, d, "labels"), "doc_id").withColumn("key", F.md5("text")).withColumn("score", F.col("doc_id") % 100)
    fit = own.where("doc_id % 2 = 1").where(F.col("score") >= F.when(F.col("quality") == 1, 50).otherwise(45)).select("key", "doc_id")
    return stores.insert_absent(own.where("doc_id % 2 = 0").select("key"), fit, "key", "doc_id").select("doc_id")


def search_union(s, d):
    """Addresses of three sources one after another, each once, the first 100."""
    pages = table(s, d, "pages").select("url", "page_id")
    return stores.union_until([pages.where("page_id % 3 = 2"), pages.where("page_id % 2 = 0"), pages], "url", "page_id", 100).select("url", "store", "page_id", "place")


def vector_store(s, d):
    """Vectors written, every hundredth replaced, ten added and those of one label deleted; read again by id."""
    folder = new_folder(s, "vectors")
    own = table(s, d, "embeddings").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))
    own.withColumn("created", F.lit(1)).write.partitionBy("label").parquet(folder)
    kept = s.read.parquet(folder).select("vec_id", "label", "first", "created")
    new = own.where("vec_id % 100 = 0").withColumn("first", F.lit(0.0)).union(s.range(10).select((-F.col("id") - 1).alias("vec_id"), F.lit(1), F.lit(1.0))).withColumn("created", F.lit(2))
    stores.upsert(kept, new, "vec_id").where("label <> 0").write.parquet(f"{folder}-next")
    return s.read.parquet(f"{folder}-next").where("vec_id < 500")


def vector_two_indexes(s, d):
    """Twice the number from each of two indexes, merged to the best ten."""
    ship(s)
    halves = [table(s, d, "embeddings").where(f"label % 2 = {i}").drop("label") for i in (0, 1)]
    parts = [vectors.top_k(vectors.score_queries(h, _searches(s, d), k=20), 20, "query_id").drop("rank") for h in halves]
    return vectors.top_k(parts[0].union(parts[1]), 10, "query_id")


def vector_keyword_entities(s, d):
    """Vectors at 0.3 or more for one of a question's keywords, by their best, the first ten."""
    ship(s)
    found = vectors.score_queries(table(s, d, "embeddings").drop("label"), _searches(s, d), least=0.3).withColumn("question", F.floor(F.col("query_id") / 20) % 5)
    return vectors.top_k(found.groupBy("question", "id").agg(F.max("score").alias("score")), 10, "question")


def vector_dimension(s, d):
    """Vectors cut to eight places and padded to seventy."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fit = lambda n: F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)
    return table(s, d, "embeddings").select("vec_id", F.size(fit(70)).alias("n"), F.round(F.aggregate(fit(8), F.lit(0.0), lambda a, x: a + x), 4).alias("head"), F.round(F.aggregate(fit(70), F.lit(0.0), lambda a, x: a + x), 4).alias("whole"))


_RULES = ", ".join(f"('{k}', '{c}', '{n}')" for k, c, n in moderation.RULES)
_DET = f"det AS (SELECT doc_id AS id, keyword, category, code FROM documents JOIN (VALUES {_RULES}) r(keyword, category, code) ON contains(lower(text), keyword))"
_CATS = sorted({c for _, c, _ in moderation.RULES})
_B = ", ".join(f"({i}, '{w}')" for i, w in enumerate(BLOCKED))
_FIRST = f"fh AS (SELECT doc_id, w AS word, place FROM (SELECT doc_id, w, strpos(text, w) AS place, row_number() OVER (PARTITION BY doc_id ORDER BY strpos(text, w), i) AS r FROM documents JOIN (VALUES {_B}) b(i, w) ON contains(text, w)) WHERE r = 1)"
_STAGED = f"""{_DET}, {_FIRST}, cat AS (SELECT id AS doc_id, 'C' || min(CAST(code[2:] AS INTEGER)) AS code FROM det GROUP BY id), bank AS (SELECT doc_id, min(item_id) AS item FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id),
st AS (SELECT doc_id, CASE WHEN fh.doc_id IS NOT NULL THEN 'C1' WHEN cat.doc_id IS NOT NULL THEN cat.code WHEN bank.doc_id IS NOT NULL THEN 'C35' END AS code,
CASE WHEN fh.doc_id IS NOT NULL THEN fh.word WHEN cat.doc_id IS NOT NULL THEN 'category' WHEN bank.doc_id IS NOT NULL THEN 'item ' || item END AS reason FROM documents LEFT JOIN fh USING (doc_id) LEFT JOIN cat USING (doc_id) LEFT JOIN bank USING (doc_id))"""
_STORE = f"""{_STAGED}, h AS (SELECT d.doc_id, text, code FROM documents d JOIN st ON st.doc_id = d.doc_id AND code IS NOT NULL), e AS (SELECT * FROM h WHERE doc_id IN (SELECT min(doc_id) FROM h WHERE doc_id % 2 = 0 GROUP BY text)),
kept AS (SELECT * FROM e UNION ALL SELECT * FROM h WHERE doc_id IN (SELECT min(doc_id) FROM h WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM e) GROUP BY text))"""
_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_LEV = "md5(text) AS k1, md5(array_to_string(list_sort(list_distinct(" + _W + r")), '|')) AS k2, md5(array_to_string(list_sort(list_distinct(regexp_split_to_array(text, '[.!?]\s*'))), '|')) AS k3"

QUERIES = {f.__name__: f for f in (
    moderation_first_hit, moderation_flags, keyword_table, moderation_segmented, moderation_staged, moderation_batch, moderation_confidence, blocked_store, blocked_stats, candidates_approved, candidates_merged,
    cache_similar_hits, cache_lru, cache_levels, session_state, log_keep_last, store_precedence, store_upsert, guarded_insert, search_union, vector_store, vector_two_indexes, vector_keyword_entities, vector_dimension)}
ORACLE = {
    "moderation_first_hit": f"WITH {_FIRST} SELECT doc_id AS id, word, place FROM fh",
    "moderation_flags": f"WITH {_DET} SELECT doc_id AS id, {', '.join(f'''coalesce(bool_or(category = '{c}'), false) AS {c}''' for c in _CATS)}, count(category) > 0 AS overall FROM documents LEFT JOIN det ON id = doc_id GROUP BY doc_id",
    "keyword_table": "SELECT keyword, risk, code FROM (VALUES ('token', 'r1', 'C2'), ('der', 'r2', 'C5'), ('eau', 'r2', 'C5')) v(keyword, risk, code)",
    "moderation_segmented": f"""WITH k(w) AS (VALUES ('token'), ('der'), ('eau')), h AS (SELECT doc_id AS id, w || ':substring' AS x FROM documents JOIN k ON contains(text, w) UNION SELECT doc_id, w || ':word' FROM documents JOIN k ON list_contains({_W}, w))
SELECT id, string_agg(x, ',' ORDER BY x) AS found FROM h GROUP BY id""",
    "moderation_staged": f"WITH {_STAGED} SELECT doc_id, code, reason FROM st WHERE code IS NOT NULL",
    "moderation_batch": f"WITH {_STAGED} SELECT lang, CAST(count(code) AS BIGINT) AS violations, CAST(count(*) - count(code) AS BIGINT) AS passes FROM documents JOIN st USING (doc_id) GROUP BY lang",
    "moderation_confidence": f"WITH {_DET}, a AS (SELECT DISTINCT id, category, 0.95::DOUBLE AS c FROM det UNION SELECT doc_id, 'bank', 0.85::DOUBLE FROM documents d JOIN benchmark b ON contains(d.text, b.text)) SELECT id, count(DISTINCT category) AS categories, round(avg(c), 6) AS confidence FROM a GROUP BY id",
    "blocked_store": f"WITH {_STORE} SELECT doc_id, code, md5(text) AS digest FROM kept",
    "blocked_stats": f"WITH {_STORE} SELECT 'code' AS kind, code AS what, count(*) AS n FROM kept GROUP BY code UNION ALL SELECT * FROM (SELECT 'last', substring(text, 1, 50), doc_id FROM kept ORDER BY doc_id DESC LIMIT 10)",
    "candidates_approved": """SELECT event_type, CAST(count_if(place IN (1, 3, 5)) AS BIGINT) AS approved, CAST(count_if(place NOT IN (1, 3, 5)) AS BIGINT) AS pending FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY max(value) DESC, user_id) AS place FROM events GROUP BY event_type, user_id) GROUP BY event_type""",
    "candidates_merged": "SELECT DISTINCT p_brand AS text, 'bank' AS source FROM part UNION ALL SELECT p_type, 'candidate' FROM part GROUP BY p_type HAVING count(*) >= 5 AND max(p_size / 50) >= 0.9",
    "cache_similar_hits": f"""WITH w AS (SELECT doc_id AS id, list_distinct({_W}) AS w FROM documents), e AS (SELECT id, len(w) AS n, unnest(w) AS t FROM w), c AS (SELECT x.id AS a, y.id AS b, x.n + y.n AS n, count(*) AS k FROM e x JOIN e y ON x.t = y.t AND x.id < y.id AND (y.id - x.id) * 10 <= 3600 GROUP BY x.id, y.id, x.n, y.n)
SELECT b AS doc_id, max(a) AS hit, round(arg_max(k / (n - k), a), 6) AS score FROM c WHERE k / (n - k) >= 0.8 GROUP BY b""",
    "cache_lru": "SELECT key, last, CAST(row_number() OVER (ORDER BY last DESC, key) AS INTEGER) AS place FROM (SELECT user_id || '/' || event_type AS key, max(event_id) AS last FROM events GROUP BY ALL ORDER BY last DESC LIMIT 100)",
    "cache_levels": f"""WITH k AS (SELECT doc_id, {_LEV} FROM documents), a AS (SELECT doc_id, {_LEV} FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, '{LOWER}', '{LOWER.upper()}') ELSE text || ' ' END AS text FROM documents WHERE doc_id % 3 = 0)),
m1 AS (SELECT k1, min(doc_id) AS i FROM k GROUP BY k1), m2 AS (SELECT k2, min(doc_id) AS i FROM k GROUP BY k2), m3 AS (SELECT k3, min(doc_id) AS i FROM k GROUP BY k3)
SELECT doc_id, CASE WHEN m1.i IS NOT NULL THEN 'text' WHEN m2.i IS NOT NULL THEN 'words' WHEN m3.i IS NOT NULL THEN 'sentences' END AS level, coalesce(m1.i, m2.i, m3.i) AS hit FROM a LEFT JOIN m1 USING (k1) LEFT JOIN m2 USING (k2) LEFT JOIN m3 USING (k3)""",
    "session_state": "SELECT user_id, count(*) AS turns, round(sum(value), 4) AS total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_type <> 'error' AND (last IS NULL OR event_id > last) GROUP BY user_id",
    "log_keep_last": "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 50",
    "store_precedence": """WITH a AS (SELECT p_name[1:4] AS name, 'part' AS store, max(p_partkey)::BIGINT AS id, 0 AS p FROM part GROUP BY ALL UNION ALL SELECT n_name[1:4], 'nation', max(n_nationkey)::BIGINT, 1 FROM nation GROUP BY ALL UNION ALL SELECT r_name[1:4], 'region', max(r_regionkey)::BIGINT, 2 FROM region GROUP BY ALL)
SELECT name, store, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p DESC) AS r FROM a) WHERE r = 1""",
    "store_upsert": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS price, 1 AS created, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS updated FROM orders UNION ALL SELECT -i - 1, 0.5::DOUBLE, 2, 2 FROM range(10) r(i)",
    "guarded_insert": "WITH o AS (SELECT d.doc_id, text, quality FROM documents d JOIN labels l USING (doc_id)) SELECT min(doc_id) AS doc_id FROM o WHERE doc_id % 2 = 1 AND doc_id % 100 >= CASE WHEN quality = 1 THEN 50 ELSE 45 END AND text NOT IN (SELECT text FROM o WHERE doc_id % 2 = 0) GROUP BY text",
    "search_union": """WITH a AS (SELECT url, 0 AS store, page_id FROM pages WHERE page_id % 3 = 2 UNION ALL SELECT url, 1, page_id FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 2, page_id FROM pages), f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY store, page_id) AS r FROM a WHERE url <> '')
SELECT url, store, page_id, CAST(row_number() OVER (ORDER BY store, page_id, url) AS INTEGER) AS place FROM f WHERE r = 1 QUALIFY place <= 100""",
    "vector_store": "SELECT vec_id, label, CASE WHEN vec_id % 100 = 0 THEN 0.0::DOUBLE ELSE round(embedding[1]::DOUBLE, 4) END AS first, 1 AS created FROM embeddings WHERE label <> 0 AND vec_id < 500 UNION ALL SELECT -i - 1, 1, 1.0, 2 FROM range(10) r(i)",
    "vector_two_indexes": f"SELECT query_id, id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE r <= 10",
    "vector_keyword_entities": f"""WITH a AS (SELECT (q.vec_id // 20) % 5 AS question, e.vec_id AS id, max({_COS}) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 GROUP BY ALL HAVING max({_COS}) >= 0.3)
SELECT question, id, score, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS INTEGER) AS rank FROM a QUALIFY rank <= 10""",
    "vector_dimension": "SELECT vec_id, 70 AS n, round(list_sum(embedding[1:8]::DOUBLE[]), 4) AS head, round(list_sum(embedding[1:70]::DOUBLE[]), 4) AS whole FROM embeddings",
}
