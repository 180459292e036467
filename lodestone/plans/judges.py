"""Judges passed in as functions, stand-ins for models, and reads of caches over the tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators import caching, judges, vectors
from lodestone.session import ship
from lodestone.sources.tables import table

TTL, STALE = 3600, 1800


def _score(pairs: list[str]) -> list[str]:
    """Stands for a model that scores (query, hit) pairs from 0 to 10; every 29th hit breaks it, every 17th gets no number."""
    out = []
    for pair in pairs:
        q, i = map(int, pair.split("|"))
        if i % 29 == 0:
            raise ValueError("broken")
        out.append("none" if i % 17 == 0 else str((q * 7 + i * 13) % 11))
    return out


def hits_reranked(s, d):
    """The ten nearest of every twentieth vector in a scorer's order; nothing that the scorer says of the third query can be read."""
    ship(s)
    every = table(s, d, "embeddings").select("vec_id", "embedding")
    asked = every.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    hits = vectors.top_k(vectors.score_queries(every, asked, k=10), 10, "query_id")
    pair = F.when(F.col("query_id") != 40, F.concat_ws("|", F.col("query_id").cast("string"), F.col("id").cast("string"))).otherwise("no pair")
    return judges.reranked(hits, pair, _score, 5, 10.0)


def _has_token(texts: list[str]) -> list[str]:
    if any("|" in t for t in texts):
        raise ValueError("bar")
    return ["Yes, it has" if "token" in t.lower() else "no" for t in texts]


def _is_seventh(texts: list[str]) -> list[str]:
    return ["YES" if len(t) % 7 == 0 else "no, not so" for t in texts]


def judged_stages(s, d):
    """Documents judged by two stand-ins in order: which one blocks, and how often one failed."""
    ship(s)
    docs = table(s, d, "documents").select("doc_id", "text")
    return judges.judged(docs, "text", {"token": _has_token, "seventh": _is_seventh}).select("doc_id", "blocked_by", "errors")


def judged_all(s, d):
    """What both stand-ins find in every document."""
    ship(s)
    return judges.all_judged(table(s, d, "documents"), "doc_id", "text", {"token": _has_token, "seventh": _is_seventh})


def _keywords(texts: list[str]) -> list[str]:
    out = []
    for t in texts:
        words = t.split()
        out.append("not JSON" if len(t) % 5 == 0 else json.dumps({"local": words[:2], "global": words[-1:]} if len(t) % 3 else {"local": []}))
    return out


def query_keywords(s, d):
    """Items asked for by name and kind: keywords as the stand-in gives them, or the query itself."""
    ship(s)
    asked = table(s, d, "items").where("name IS NOT NULL AND kind IS NOT NULL").select("item_id", F.concat_ws(" ", "name", "kind").alias("q"))
    return judges.query_keywords(asked, "q", _keywords).select("item_id", F.array_join("local", "|").alias("local"), F.array_join("global", "|").alias("global"))


def cache_reads(s, d):
    """Views read what a click has put in for the client within the hour, unless an error has dropped it or a signup has cleared all."""
    op = F.expr("CASE kind WHEN 'view' THEN 'get' WHEN 'click' THEN 'set' WHEN 'error' THEN 'drop' WHEN 'signup' THEN 'clear' END")
    log = table(s, d, "clicks").select("click_id", "client_id", "ts", op.alias("op"))
    return caching.cache_hits(log, "client_id", "ts", "click_id", "op", TTL).select("click_id", "hit")


def trends_served(s, d):
    """Views get the trends of the last purchase before, which are stale after half an hour."""
    c = table(s, d, "clicks").where("ts IS NOT NULL").select("click_id", "kind", F.col("ts").cast("timestamp").alias("ts"))
    taken = c.where("kind = 'purchase'").select(F.col("ts").alias("taken"))
    found = caching.served(c.where("kind = 'view'").select("click_id", "ts"), taken, "ts", STALE)
    return found.select("click_id", F.date_format("snapshot", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("snapshot"), "stale")


QUERIES = {f.__name__: f for f in (hits_reranked, judged_stages, judged_all, query_keywords, cache_reads, trends_served)}
_HITS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), h AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(coalesce(list_cosine_similarity(v.e, q.e), 0), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(coalesce(list_cosine_similarity(v.e, q.e), 0), 6) DESC, v.vec_id) AS rank FROM v, v q WHERE q.vec_id % 20 = 0) WHERE rank <= 10)"
_TOKEN = "(NOT contains(text, '|') AND contains(lower(text), 'token'))"
ORACLE = {
    "hits_reranked": f"""WITH {_HITS}, s AS (SELECT *, CASE WHEN query_id <> 40 AND id % 29 <> 0 AND id % 17 <> 0 THEN ((query_id * 7 + id * 13) % 11) / 10 END AS s FROM h),
u AS (SELECT *, CASE WHEN count(s) OVER (PARTITION BY query_id) > 0 THEN s ELSE score END AS u FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY u DESC NULLS LAST, rank, id) AS n FROM u),
k AS (SELECT *, coalesce(u, min(u) OVER (PARTITION BY query_id), 0) AS f FROM o WHERE n <= 5)
SELECT query_id, id, rank::INTEGER AS original_rank, n::INTEGER AS new_rank, CASE WHEN max(f) OVER w = min(f) OVER w THEN 1 ELSE round((f - min(f) OVER w) / (max(f) OVER w - min(f) OVER w), 6) END AS score FROM k WINDOW w AS (PARTITION BY query_id)""",
    "judged_stages": f"SELECT doc_id, CASE WHEN {_TOKEN} THEN 'token' WHEN length(text) % 7 = 0 THEN 'seventh' END AS blocked_by, coalesce(contains(text, '|'), false)::INTEGER AS errors FROM documents",
    "judged_all": f"SELECT doc_id, nullif(concat_ws(',', CASE WHEN length(text) % 7 = 0 THEN 'seventh' END, CASE WHEN {_TOKEN} THEN 'token' END), '') AS categories, CASE WHEN length(text) % 7 = 0 OR {_TOKEN} THEN 0.85::DOUBLE ELSE 0 END AS confidence FROM documents",
    "query_keywords": """WITH i AS (SELECT item_id, name || ' ' || kind AS q FROM items WHERE name IS NOT NULL AND kind IS NOT NULL), k AS (SELECT item_id, q, string_split(q, ' ') AS w, length(q) % 5 <> 0 AND length(q) % 3 <> 0 AS ok FROM i)
SELECT item_id, CASE WHEN ok THEN array_to_string(w[1:2], '|') ELSE q END AS local, CASE WHEN ok THEN w[-1] ELSE '' END AS "global" FROM k""",
    "cache_reads": f"""WITH c AS (SELECT click_id, client_id, ts, kind, {{'t': ts, 'o': click_id}} AS o FROM clicks WHERE ts IS NOT NULL), w AS (SELECT click_id, client_id, ts, kind, o, max(o) FILTER (kind = 'click') OVER p AS put, max(o) FILTER (kind = 'error') OVER p AS gone
FROM c WHERE client_id IS NOT NULL AND kind IN ('view', 'click', 'error') WINDOW p AS (PARTITION BY client_id ORDER BY ts, click_id ROWS UNBOUNDED PRECEDING)),
x AS (SELECT o FROM c WHERE kind = 'signup')
SELECT click_id, coalesce(ts - put.t <= INTERVAL {TTL} SECOND AND (gone IS NULL OR gone < put) AND NOT EXISTS (SELECT 1 FROM x WHERE x.o > w.put AND x.o < w.o), false) AS hit FROM w WHERE kind = 'view'""",
    "trends_served": f"""WITH v AS (SELECT click_id, ts FROM clicks WHERE kind = 'view' AND ts IS NOT NULL), p AS (SELECT DISTINCT ts AS taken FROM clicks WHERE kind = 'purchase' AND ts IS NOT NULL)
SELECT click_id, strftime(taken, '%Y-%m-%d %H:%M:%S.%f') AS snapshot, coalesce(v.ts - taken > INTERVAL {STALE} SECOND, true) AS stale FROM v ASOF LEFT JOIN p ON v.ts >= taken""",
}
