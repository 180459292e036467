"""Recall, moods, what is due, repeated texts, crawls, and searches with their fallbacks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import chunking, recall, vectors
from lodestone.plans import decisions, lexical
from lodestone.session import ship
from lodestone.sources.shared import new_folder, settled
from lodestone.sources.tables import table

PHRASES = ["", "上次", "之前说的", "刚才 wow", "最开始", "太棒了 开心", "担心 怎么办", "好累"]
USERS, FOUND = 97, 5
CUT = 0.15
#: A capitalised word between other characters than ASCII ones of words, as the SQL's engine reads its word boundaries.
NAMED = r"(?<![A-Za-z0-9_])([A-Z][a-z]{2,})(?![A-Za-z0-9_])"


def _said(s, d):
    n = F.col("conv_id") + F.col("turn")
    return table(s, d, "conversations").select("conv_id", "turn", "role", F.concat(decisions._pick(PHRASES, n), F.lit(" "), "text").alias("said"))


def moods(s, d):
    """Mood, its intensity and the tone of the answer for every turn."""
    return _said(s, d).select("conv_id", "turn", recall.mood(F.col("said")).alias("m")).select("conv_id", "turn", "m.*")


def category_codes(s, d):
    """Codes of documents whose categories go by number, two of them unknown."""
    kinds = [*recall.CODES, "other", ""]
    return table(s, d, "documents").groupBy(recall.category_code(decisions._pick(kinds, F.col("doc_id"))).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def memories_recalled(s, d):
    """What the last turn of every twentieth conversation recalls of its user's conversations, of which the first turn is the summary."""
    said = _said(s, d)
    last = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    asked = said.where("conv_id % 20 = 0").withColumn("n", F.row_number().over(last)).where("n = 1")
    found = F.array_distinct(F.regexp_extract_all("said", F.lit(NAMED), F.lit(1)))
    asked = asked.select(F.col("conv_id").alias("query_id"), (F.col("conv_id") % USERS).alias("user"), "said", found.alias("entities"))
    kept = table(s, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % USERS).alias("user"), F.col("text").alias("summary"))
    return recall.memories(asked, kept, FOUND)


def sessions_due(s, d):
    """Clients whose dialog or profile is due at the last click: the last purchase was when it was done."""
    states = table(s, d, "clicks").where("client_id IS NOT NULL").groupBy("client_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.length(F.coalesce("props", F.lit("")))).alias("chars"), F.max(F.when(F.col("kind") == "purchase", F.col("ts").cast("timestamp"))).alias("done_at"), F.max(F.col("ts").cast("timestamp")).alias("now"))
    return recall.due(states, F.col("now"), 5, 200, 300).select("client_id", "summary_due", "profile_due")


def dialog_contexts(s, d):
    """Summary of what is archived and the last three turns of every conversation."""
    turns = table(s, d, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    summed = turns.join(last, "conv_id").where("turn <= last - 3").groupBy("conv_id").agg(F.concat(F.lit("earlier turns: "), F.count(F.lit(1)).cast("string")).alias("summary"))
    return recall.dialog_contexts(turns, summed, "conv_id", "turn", 3).select("conv_id", F.md5("context").alias("digest"))


def layer_repeats(s, d):
    """Documents of odd ids that repeat what their language's layer of even ids holds, word for word or nearly so of its five latest."""
    docs = table(s, d, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    new = docs.where("doc_id % 2 = 1")
    late = docs.where("doc_id % 2 = 0")
    near = late.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("doc_id")))).where("n = 2").select((-F.col("doc_id") - 1).alias("doc_id"), "lang", F.concat("text", F.lit(" besides")).alias("text"))
    found = recall.repeats(new.union(near), late, "lang", "text", "doc_id")
    return found.where("duplicate IS NOT NULL").select("doc_id", "duplicate")


def entity_places(s, d):
    """Every place of a few patterns in every document, case aside."""
    return recall.places(table(s, d, "documents"), ["the", "nana", "eau", "."], "doc_id", "text")


def crawl_directed(s, d):
    """Up to sixty pages reached from every twentieth page along links from page to page, in at most two steps."""
    n = F.col("page_id")
    pages = settled(table(s, d, "pages").select(n.alias("page_id"), "url"))
    to = pages.select(F.explode(F.array(n * 3 + 1, n * 5 + 2, n * 7)).alias("page_id"), F.col("url").alias("src"))
    links = to.join(pages, "page_id").select("src", F.col("url").alias("dst"))
    return recall.crawled(links, pages.where("page_id % 20 = 0").select("url"), 2, 60)


def vector_truncated(s, d):
    """Cosine of each vector with the first half of the next one, over the length that both have."""
    v = table(s, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.slice("embedding", 1, F.floor(F.size("embedding") / 2).cast("int")).alias("half"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(vectors.cosine(F.slice("embedding", 1, F.least(F.size("embedding"), F.size("half"))), F.slice("half", 1, F.least(F.size("embedding"), F.size("half")))), 6).alias("score"))


def bm25_normalised(s, d):
    """The best of each search with scores from 0 to 1, 1 where all are equal."""
    found = lexical.QUERIES["bm25_topk"](s, d)
    own = W.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return found.withColumn("norm", F.when(high == low, 1.0).otherwise(F.round((F.col("score") - low) / (high - low), 4))).select("query_id", "id", "norm")


def _typed(s, d):
    ship(s)
    every = table(s, d, "embeddings").select("vec_id", "embedding", "label")
    asked = every.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return every, asked


def vector_overfetched(s, d):
    """Three times the wanted hits of each search, of which the first five whose key has the type's prefix stay."""
    every, asked = _typed(s, d)
    found = vectors.top_k(vectors.score_queries(every.drop("label"), asked, k=15), 15, "query_id")
    keyed = found.withColumn("key", F.concat(F.when(F.col("id") % 3 == 0, "product_").otherwise("entry_"), F.col("id").cast("string")))
    kept = keyed.where(F.col("key").startswith("entry_")).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where("place <= 5")
    return kept.select("query_id", "key", "place")


def threshold_fallback(s, d):
    """Hits whose score, or else fused score, or else 1, reaches the threshold."""
    n = F.col("doc_id")
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.when(F.col("quality").isNotNull(), F.col("quality") * 0.4 + 0.2).alias("score"), F.when(n % 3 > 0, (n % 10) / 10).alias("rrf"))
    used = F.coalesce("score", "rrf", F.lit(1.0))
    return rows.select("doc_id", F.round(used, 6).alias("used")).where("used >= 0.5")


def history_blocked(s, d):
    """Searches whose best match among the vectors kept as blocked, written by code, is similar enough."""
    every, asked = _typed(s, d)
    folder = new_folder(s, "history")
    every.where("vec_id % 3 = 1").withColumn("code", F.concat(F.lit("C"), F.col("label"))).write.partitionBy("code").parquet(folder)
    kept = s.read.parquet(folder)
    best = vectors.top_k(vectors.score_queries(kept.select("vec_id", "embedding", "code"), asked, least=0.3, k=1), 1, "query_id")
    return best.select("query_id", "id", "code", "score")


def merged_ranks(s, d):
    """Hits of two searches joined: ranks of both, the weighted score, and the content of the better side."""
    g = table(s, d, "labels").where("quality = 1").select("doc_id", (1 / (F.col("doc_id") % 7 + 1)).alias("score"))
    v = table(s, d, "documents").where("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") % 100 / 100).alias("score"))
    rank = lambda: F.row_number().over(W.orderBy(F.desc("score"), "doc_id"))
    first = lambda df: df.orderBy(F.desc("score"), "doc_id").limit(200).withColumn("rank", rank())  # noqa: E731  200 rows
    g, v = first(g), first(v)
    both = g.select("doc_id", F.col("score").alias("g"), F.col("rank").alias("graph_rank")).join(v.select("doc_id", F.col("score").alias("v"), F.col("rank").alias("vector_rank")), "doc_id", "full")
    total = F.round(F.coalesce("g", F.lit(0.0)) * 0.6 + F.coalesce("v", F.lit(0.0)) * 0.4, 6)
    side = F.when(F.coalesce(F.col("g") * 0.6 >= F.coalesce(F.col("v") * 0.4, F.lit(0.0)), F.lit(False)), "graph").otherwise("vector")
    return both.select("doc_id", "graph_rank", "vector_rank", total.alias("score"), side.alias("content_of"))


def list_appended(s, d):
    """A list by kind kept in a table: a second batch is appended, and of each list the last twenty stay."""
    folder = new_folder(s, "list")
    own = table(s, d, "clicks").where("kind IS NOT NULL").select("kind", "click_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    own.where("click_id % 2 = 0").write.parquet(folder)
    own.where("click_id % 2 = 1").write.mode("append").parquet(folder)
    newest = W.partitionBy("kind").orderBy(F.desc("click_id"), F.desc("value"))
    kept = s.read.parquet(folder).withColumn("place", F.row_number().over(newest)).where("place <= 20")
    kept.select("kind", "click_id", "place").write.parquet(f"{folder}-kept")
    return s.read.parquet(f"{folder}-kept")


def resumed_run(s, d):
    """Vectors made in two runs: the second reads what the first has written and makes only the rest; which run made each."""
    folder = new_folder(s, "run")
    todo = table(s, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    made = lambda df, run: df.select("doc_id", "size", F.lit(run).alias("run"))
    made(todo.where("doc_id % 4 < 3"), 1).write.parquet(folder)
    done = s.read.parquet(folder).select("doc_id")
    made(todo.join(done, "doc_id", "left_anti"), 2).write.mode("append").parquet(folder)
    return s.read.parquet(folder).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.countDistinct("doc_id").alias("docs"))


def store_reset(s, d):
    """Knowledge by the start of its MD5: what is added again is as new, with its usage at 0; of a key added twice the last row counts."""
    items = table(s, d, "items").where("name IS NOT NULL")
    key = lambda c: F.substring(F.md5(c), 1, 16).alias("key")
    old = items.groupBy(key(F.col("name"))).agg(F.max("item_id").alias("at"), F.count(F.lit(1)).alias("used"))
    new = items.where("item_id % 4 = 0 AND kind = 'home'").groupBy(key(F.col("name"))).agg((F.max("item_id") + 1_000_000).alias("at"), F.lit(0).cast("long").alias("used"))
    every = old.unionByName(new)
    return every.groupBy("key").agg(F.max(F.struct("at", "used")).alias("r")).select("key", "r.at", "r.used")


def store_counts(s, d):
    """Rows by model and by source, and by layer with the total; a missing source has a name of its own."""
    own = table(s, d, "clients").select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("segment", F.lit("none")).alias("model"))
    counted = own.groupingSets([["source"], ["model"], []], "source", "model").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("source", "model", "n")


def chunk_parents_cosine(s, d):
    """Parents of documents cut where neighbouring sentences have few words in common, or at 512 tokens."""
    ship(s)
    docs = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    cut = docs.withColumn("sentences", chunking.sentences(F.col("text"))).where(F.size("sentences") > 0)
    alike = cut.select("doc_id", "text", recall.neighbour_cosines(F.col("sentences")).alias("alike"))
    found = alike.select("doc_id", F.posexplode(chunking.parents(F.col("text"), F.col("alike"), CUT)).alias("parent", "p"))
    return found.select("doc_id", "parent", F.col("p.tokens").alias("tokens"), F.md5("p.text").alias("digest"))


def chunks_enriched(s, d):
    """Parents with their document's language and source; authority and category only where the document gives none."""
    classes = decisions.document_classes(s, d)
    docs = table(s, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, "given").alias("own"))
    chunks = chunk_parents_cosine(s, d)
    both = chunks.join(docs, "doc_id").join(classes, "doc_id")
    return both.groupBy("lang", F.coalesce("own", "authority").alias("authority"), "category").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"))


QUERIES = {f.__name__: f for f in (
    moods, category_codes, memories_recalled, sessions_due, dialog_contexts, layer_repeats, entity_places, crawl_directed, vector_truncated, bm25_normalised, vector_overfetched, threshold_fallback, history_blocked,
    merged_ranks, list_appended, resumed_run, store_reset, store_counts, chunk_parents_cosine, chunks_enriched)}
_SAID = f"sd AS (SELECT conv_id, turn, role, {decisions._item(PHRASES, '(conv_id + turn)')} || ' ' || text AS said FROM conversations)"


def _count(column, listed):
    return "(" + " + ".join(f"contains({column}, '{w}')::INTEGER" for w in listed) + ")"


_MOOD = "list_min([" + ", ".join(f"{{'n': -{_count('l', ws)}, 'i': {i}, 'mood': '{m}', 'tone': '{recall.TONES[m]}'}}" for i, (m, ws) in enumerate(recall.MOODS.items())) + "])"
_TIME = "CASE " + " ".join(f"WHEN {_count('q', ws)} > 0 THEN {n}" for n, ws in recall.TIMES) + " ELSE 0 END"
_SENTS = r"""sn AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
sx AS (SELECT doc_id, CAST(i AS INTEGER) AS i, l[i] AS t FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM sn)),
sw AS (SELECT doc_id, i, w, count(*) AS n FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS w FROM sx) GROUP BY ALL),
sm AS (SELECT doc_id, i, sqrt(sum(n * n)) AS norm FROM sw GROUP BY ALL), sp AS (SELECT a.doc_id, a.i, sum(a.n * b.n) AS dot FROM sw a JOIN sw b ON a.doc_id = b.doc_id AND a.w = b.w AND a.i = b.i + 1 GROUP BY ALL)"""
_COSINE = f"""{_SENTS}, x AS (SELECT doc_id, i, t, length(t) // 4 + 1 AS k, i > 1 AND round(coalesce(dot / (m.norm * q.norm), 0), 6) < {CUT} AS cut FROM sx LEFT JOIN sp USING (doc_id, i) LEFT JOIN sm m USING (doc_id, i) LEFT JOIN sm q ON q.doc_id = sx.doc_id AND q.i = sx.i - 1),
f AS (SELECT doc_id, i, k AS total, 0 AS part FROM x WHERE i = 1 UNION ALL
SELECT x.doc_id, x.i, CASE WHEN total + k > 512 OR cut THEN k ELSE total + k END, CASE WHEN total + k > 512 OR cut THEN part + 1 ELSE part END FROM f JOIN x ON x.doc_id = f.doc_id AND x.i = f.i + 1),
p AS (SELECT doc_id, part, string_agg(t, '' ORDER BY i) AS ptext FROM f JOIN x USING (doc_id, i) GROUP BY doc_id, part),
cp AS (SELECT doc_id, part AS parent, CAST(length(ptext) // 4 + 1 AS BIGINT) AS tokens, md5(ptext) AS digest FROM p)"""
_EV = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL)"
_SCORED = f"{_EV}, sc AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, round(coalesce(list_cosine_similarity(v.e, q.e), 0), 6) AS score FROM v, v q WHERE q.vec_id % 20 = 0)"
ORACLE = {
    "moods": f"WITH {_SAID}, m AS (SELECT conv_id, turn, {_MOOD} AS b FROM (SELECT *, lower(coalesce(said, '')) AS l FROM sd)) SELECT conv_id, turn, CASE WHEN b.n < 0 THEN b.mood ELSE 'neutral' END AS mood, CASE WHEN b.n < 0 THEN least(round(-b.n * 0.3::DOUBLE, 6), 1) ELSE 0.3::DOUBLE END AS intensity, CASE WHEN b.n < 0 THEN b.tone ELSE 'normal' END AS tone FROM m",
    "category_codes": f"SELECT coalesce((MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in recall.CODES.items())}}})[{decisions._item([*recall.CODES, 'other', ''], 'doc_id')}], 'C2') AS code, count(*) AS n FROM documents GROUP BY 1",
    "memories_recalled": rf"""WITH {_SAID}, a AS (SELECT conv_id AS query_id, conv_id % {USERS} AS user, lower(said) AS q, list_distinct(regexp_extract_all(said, '\b([A-Z][a-z]{{2,}})\b', 1)) AS es FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM sd WHERE conv_id % 20 = 0) WHERE r = 1),
b AS (SELECT query_id, conv_id AS session_id, q, len(list_filter(es, lambda e: contains(lower(text), lower(e)))) AS named FROM a JOIN conversations ON conv_id % {USERS} = a.user AND conversations.turn = 0 AND text <> ''),
c AS (SELECT query_id, session_id, named, named * 10 + {_count('q', recall.BACK)} * 5 AS kw, {_TIME} AS tm FROM b),
r AS (SELECT query_id, session_id, (kw + tm + named * 15)::INTEGER AS score, CASE WHEN kw > 0 THEN 'keyword' WHEN tm > 0 THEN 'time' WHEN named > 0 THEN 'entity' END AS method FROM c)
SELECT query_id, session_id, score, method, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id) AS place FROM r WHERE score > 0) WHERE place <= {FOUND}""",
    "sessions_due": """WITH s AS (SELECT client_id, count(*) AS turns, sum(length(coalesce(props, ''))) AS chars, max(ts) FILTER (kind = 'purchase') AS done, max(ts) AS now FROM clicks WHERE client_id IS NOT NULL GROUP BY client_id),
c AS (SELECT *, coalesce(now - done >= INTERVAL 300 SECOND, true) AS cold FROM s) SELECT client_id, cold AND (turns >= 5 OR chars >= 200) AS summary_due, cold AND turns >= 5 AS profile_due FROM c""",
    "dialog_contexts": """WITH t AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations), s AS (SELECT conv_id, 'earlier turns: ' || count(*) AS summary FROM t WHERE turn <= last - 3 GROUP BY conv_id)
SELECT conv_id, md5(concat_ws(chr(10), summary, said)) AS digest FROM (SELECT conv_id, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn) AS said FROM t WHERE r <= 3 GROUP BY conv_id) LEFT JOIN s USING (conv_id)""",
    "layer_repeats": r"""WITH d AS (SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS n FROM d WHERE doc_id % 2 = 0),
w AS (SELECT doc_id, lang, text FROM d WHERE doc_id % 2 = 1 UNION ALL SELECT -doc_id - 1, lang, text || ' besides' FROM e WHERE n = 2),
b AS (SELECT lang, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS bag FROM e WHERE n <= 5), x AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS own FROM w),
r AS (SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.lang = x.lang AND md5(e.text) = md5(x.text)) THEN 'exact'
WHEN len(own) > 0 AND EXISTS (SELECT 1 FROM b WHERE b.lang = x.lang AND len(list_intersect(bag, own)) >= 0.8 * len(list_distinct(list_concat(bag, own)))) THEN 'similar' END AS duplicate FROM x) SELECT * FROM r WHERE duplicate IS NOT NULL""",
    "entity_places": """WITH p(pattern) AS (VALUES ('the'), ('nana'), ('eau'), ('.')), t AS (SELECT doc_id AS id, pattern, lower(text) AS t FROM documents, p WHERE contains(lower(text), pattern)),
s AS (SELECT id, pattern, t, string_split(t, pattern[1]) AS l FROM t), q AS (SELECT id, pattern, t, unnest(list_transform(range(1, len(l)), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x))) + i)) AS place FROM s)
SELECT id, pattern, place::INTEGER AS place FROM q WHERE substr(t, place::BIGINT, length(pattern)) = pattern""",
    "crawl_directed": """WITH RECURSIVE l AS (SELECT DISTINCT a.url AS src, b.url AS dst FROM (SELECT url, unnest([page_id * 3 + 1, page_id * 5 + 2, page_id * 7]) AS k FROM pages) a JOIN pages b ON b.page_id = k),
h0 AS (SELECT DISTINCT url, 0 AS hop FROM pages WHERE page_id % 20 = 0), h1 AS (SELECT DISTINCT dst AS url, 1 AS hop FROM h0 JOIN l ON url = src WHERE dst NOT IN (SELECT url FROM h0) ORDER BY url LIMIT 60),
h2 AS (SELECT DISTINCT dst AS url, 2 AS hop FROM h1 JOIN l ON url = src WHERE dst NOT IN (SELECT url FROM h0) AND dst NOT IN (SELECT url FROM h1) ORDER BY url LIMIT 60)
SELECT * FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) ORDER BY hop, url LIMIT 60""",
    "vector_truncated": f"WITH {_EV} SELECT a.vec_id, round(coalesce(list_cosine_similarity(a.e[1:len(b.e) // 2], b.e[1:len(b.e) // 2]), 0), 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1",
    "bm25_normalised": f"SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 4) END AS norm FROM ({lexical.ORACLE['bm25_topk']}) WINDOW w AS (PARTITION BY query_id)",
    "vector_overfetched": f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc), e AS (SELECT query_id, 'entry_' || id AS key, row_number() OVER (PARTITION BY query_id ORDER BY r) AS place FROM r WHERE r <= 15 AND id % 3 <> 0) SELECT query_id, key, place::INTEGER AS place FROM e WHERE place <= 5",
    "threshold_fallback": "SELECT * FROM (SELECT doc_id, round(coalesce(quality * 0.4::DOUBLE + 0.2::DOUBLE, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10 END, 1), 6) AS used FROM documents LEFT JOIN labels USING (doc_id)) WHERE used >= 0.5",
    "history_blocked": f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM sc WHERE id % 3 = 1 AND score >= 0.3) SELECT query_id, id, 'C' || label AS code, score FROM r WHERE r = 1",
    "merged_ranks": """WITH g AS (SELECT doc_id, 1 / (doc_id % 7 + 1) AS s, row_number() OVER (ORDER BY 1 / (doc_id % 7 + 1) DESC, doc_id) AS r FROM labels WHERE quality = 1), v AS (SELECT doc_id, n_chars % 100 / 100 AS s, row_number() OVER (ORDER BY n_chars % 100 / 100 DESC, doc_id) AS r FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, g.r::INTEGER AS graph_rank, v.r::INTEGER AS vector_rank, round(coalesce(g.s, 0) * 0.6::DOUBLE + coalesce(v.s, 0) * 0.4::DOUBLE, 6) AS score, CASE WHEN coalesce(g.s * 0.6::DOUBLE >= coalesce(v.s * 0.4::DOUBLE, 0), false) THEN 'graph' ELSE 'vector' END AS content_of
FROM (SELECT * FROM g WHERE r <= 200) g FULL JOIN (SELECT * FROM v WHERE r <= 200) v USING (doc_id)""",
    "list_appended": "SELECT kind, click_id, place::INTEGER AS place FROM (SELECT kind, click_id, row_number() OVER (PARTITION BY kind ORDER BY click_id DESC, coalesce(value, 0) DESC) AS place FROM clicks WHERE kind IS NOT NULL) WHERE place <= 20",
    "resumed_run": "SELECT CASE WHEN doc_id % 4 < 3 THEN 1 ELSE 2 END AS run, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS size, count(DISTINCT doc_id) AS docs FROM documents GROUP BY 1",
    "store_reset": """WITH o AS (SELECT substr(md5(name), 1, 16) AS key, max(item_id) AS last, count(*) AS used, max(item_id) FILTER (item_id % 4 = 0 AND kind = 'home') AS again FROM items WHERE name IS NOT NULL GROUP BY 1)
SELECT key, CASE WHEN again IS NOT NULL THEN again + 1000000 ELSE last END AS "at", CASE WHEN again IS NOT NULL THEN 0 ELSE used END AS used FROM o""",
    "store_counts": "SELECT source, model, count(*) AS n FROM (SELECT coalesce(source, 'none') AS source, coalesce(segment, 'none') AS model FROM clients) GROUP BY GROUPING SETS ((source), (model), ())",
    "chunk_parents_cosine": f"WITH RECURSIVE {_COSINE} SELECT * FROM cp",
    "chunks_enriched": f"""WITH RECURSIVE {_COSINE}, cl AS ({decisions.ORACLE['document_classes']}) SELECT lang, CASE WHEN doc_id % 5 = 0 THEN 'given' ELSE authority END AS authority, category, count(*) AS chunks, sum(tokens)::BIGINT AS tokens
FROM cp JOIN documents USING (doc_id) JOIN cl USING (doc_id) GROUP BY ALL""",
}
