"""Files, sinks, text rules, caches, entity names and batched calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.operators import batches, caching, dedup, entities, vectors
from lodestone.plans.retrieval import _COS
from lodestone.session import ship
from lodestone.sources import files, sinks
from lodestone.sources.shared import new_folder
from lodestone.sources.table_tools import authority
from lodestone.sources.tables import table

NAMES = ["blue bolts", "hot gears", "smal ring", "red wigdet"]
PATTERNS = ["licensed under", "token", "eau", "@"]
TTL, WANTED = 1800, 120


def import_json(s, d):
    """Items written as JSON lines beside a malformed line, and read again."""
    folder, items = new_folder(s, "import-json"), table(s, d, "benchmark")
    items.write.json(folder)
    s.createDataFrame([('{"item_id": 1, "text": ',)], "value string").coalesce(1).write.mode("append").text(folder)
    return files.json_rows(s, folder, items.schema).select("item_id", F.md5("text").alias("digest"))


def import_csv(s, d):
    """Items as CSV with a header, with quotes and line ends in fields; routed as entries."""
    folder = new_folder(s, "import-csv")
    made = table(s, d, "benchmark").select(F.concat(F.lit('Item "'), "item_id", F.lit('"')).alias("title"), F.col("text").alias("content"), F.lit("a, b").alias("tags"))
    made.write.option("header", True).option("escape", '"').csv(folder)
    _, entries = files.routed(files.csv_rows(s, folder))
    return entries.select("title", F.md5("content").alias("digest"), F.array_join("tags", "|").alias("tags"))


def import_markdown(s, d):
    """Items as sections of Markdown files."""
    folder = new_folder(s, "import-md")
    head = F.concat(F.lit("# Item "), "item_id", F.lit("\n**Tags:** a, b\n**Source:** s"), "item_id", F.lit("\n## 内容\n"), "text")
    table(s, d, "benchmark").select(head.alias("value")).write.text(folder)
    found = files.markdown_sections(s, folder)
    return found.select("title", F.md5("content").alias("digest"), F.col("meta")["tags"].alias("tags"), F.col("meta")["source"].alias("source"))


def sink_replace_partition(s, d):
    """Orders by status; the partition F is then replaced by its dearer orders alone."""
    folder, orders = new_folder(s, "sink"), table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.replace_partitions(orders, folder, "o_orderstatus")
    sinks.replace_partitions(orders.where("o_orderstatus = 'F' AND o_totalprice > 100000"), folder, "o_orderstatus")
    return s.read.parquet(folder).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("most"))


def sink_bounded_files(s, d):
    """Rows of files of at most 100 rows each."""
    folder = new_folder(s, "files")
    sinks.bounded_files(table(s, d, "documents").select("doc_id"), folder, 100)
    by_file = s.read.parquet(folder).select("_metadata.file_path").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return by_file.agg(F.sum("n").alias("total"), F.every(F.col("n") <= 100).alias("bounded"))


def sink_log_by_day(s, d):
    """Events appended as JSON lines by day, read back and counted."""
    folder = new_folder(s, "log")
    sinks.append_log(table(s, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day")), folder, "day")
    back = s.read.schema("event_id long, event_type string, day string").json(folder)
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def think_strip(s, d):
    said = F.concat(F.lit("<think>plan\n"), "role", F.lit("</think>\n "), "text")
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(rules.without_thoughts(said)).alias("digest"))


def json_extract(s, d):
    said = F.concat(F.lit("Here it is:\n"), "props", F.lit("\ndone"))
    return table(s, d, "events").select("event_id", rules.json_object(said, "k long")["k"].alias("k"))


def inverted_abstract(s, d):
    """Texts rebuilt from their inverted index."""
    terms = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    return table(s, d, "benchmark").select("item_id", F.md5(rules.rebuilt(rules.inverted(terms))).alias("digest"))


def lang_detect(s, d):
    return table(s, d, "documents").select("doc_id", rules.language_of(F.col("text")).alias("lang_tag"))


def dedup_base_id(s, d):
    """Best chunk of each base id; ties go to the least vector id."""
    chunks = table(s, d, "embeddings").select("vec_id", F.concat(F.lit("p"), "label", F.lit("_chunk_"), "vec_id").alias("chunk_id"), F.col("embedding")[0].cast("double").alias("score"))
    return dedup.best_by(chunks, rules.base_id(F.col("chunk_id")), "score", "vec_id").withColumnRenamed("key", "base")


def dedup_literature(s, d):
    """First page by its address, else by the first 50 characters of its title; without either it goes."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    doi = F.when(F.col("page_id") % 7 == 0, F.col("url")).otherwise("")
    key = F.nullif(F.coalesce(F.nullif(doi, F.lit("")), F.substring(F.lower(title), 1, 50)), F.lit(""))
    return dedup.first_by(table(s, d, "pages").select("page_id", key.alias("key")), F.col("key"), "page_id", ["key"])


def cache_ttl_hits(s, d):
    log = table(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    return caching.ttl_hits(log, ["user_id", "event_type"], "ts", "event_id", TTL).select("event_id", "hit")


def cache_hit_rate(s, d):
    return cache_ttl_hits(s, d).agg(F.count(F.lit(1)).alias("uses"), F.count_if("hit").alias("hits"), F.format_string("%.1f%%", F.avg(F.col("hit").cast("int")) * 100).alias("rate"))


def source_cascade(s, d):
    tier = F.when(authority(F.col("source")) == 0.95, 1).when(authority(F.col("source")) == 0.8, 2).otherwise(3)
    counts = table(s, d, "documents").where("lang IS NOT NULL").groupBy("lang", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return caching.cascade(counts, "lang", "tier", "n", WANTED)


def low_load_hours(s, d):
    """Hours with fewer than 8 requests."""
    hours = table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return hours.where("n < 8").select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n")


def entity_fuzzy(s, d):
    return entities.near_names(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), NAMES)


def entity_mentions(s, d):
    return entities.mentions(table(s, d, "documents"), PATTERNS)


def _echo(texts: list[str]) -> list[str]:
    """Stands for a model: first 20 characters in upper case, one for one; fails on texts with a line end."""
    if any("\n" in t for t in texts):
        raise ValueError("line end")
    return ["".join(map(_capital, t[:20])) for t in texts]


def _capital(letter: str) -> str:
    """The one letter that is the capital of another, where there is one."""
    return next((c for c in (letter.upper(), letter.title(), "ẞ" if letter == "ß" else letter) if len(c) == 1), letter)


def model_batch(s, d):
    ship(s)
    return batches.call_batch(table(s, d, "benchmark"), "text", _echo).select("item_id", "reply", "error")


def labelled_fields(s, d):
    """Parts written as labelled lines and parsed again."""
    text = rules.composed([("产品名称", F.col("p_name")), ("品牌", F.col("p_brand")), ("类别", F.nullif(F.col("p_type"), F.lit("SMALL"))), ("价格", F.col("p_size").cast("string"))])
    name, brand, kind, size = rules.labelled(F.col("t"), ["产品名称", "品牌", "类别", "价格"])
    return table(s, d, "part").select("p_partkey", text.alias("t")).select("p_partkey", name.alias("name"), brand.alias("brand"), kind.alias("category"), size.alias("price"))


def rerank_scores(s, d):
    """Scores read from replies, half of them JSON with a number missing, half plain text."""
    k = F.get_json_object("props", "$.k")
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('ok {"scores": ['), k, F.lit(', 7]}'))).otherwise(F.concat(F.lit("scores: "), k, F.lit(" and 8.5")))
    scores = rules.reply_scores(F.col("r"), 3)
    return table(s, d, "events").select("event_id", reply.alias("r")).select("event_id", *[F.round(scores[i], 6).alias(f"s{i}") for i in range(3)])


def semantic_dedup_greedy(s, d):
    """Vectors in id order, without those that resemble one kept before."""
    own = table(s, d, "embeddings").select("vec_id", "embedding")
    ship(s)
    return vectors.greedy_distinct(own, 0.3).select("vec_id")


def entity_multi(s, d):
    return entities.multi_match(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), [*NAMES, "a red ring and a blue bolt"])


def review_candidates(s, d):
    """Candidates of high value and frequency that are old enough, marked for approval from a higher bar on."""
    seen = table(s, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("best"), F.count(F.lit(1)).alias("times"), F.min("ts").alias("first"))
    old = seen.where("best >= 100 AND times >= 5 AND first < TIMESTAMP '2024-01-24'")
    return old.select("user_id", "event_type", "times", ((F.col("best") >= 150) & (F.col("times") >= 10)).alias("approved"))


def best_source(s, d):
    """Type of the best success rate for each day; ties go to the first name."""
    rate = table(s, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("rate"))
    best = rate.groupBy("day").agg(F.min(F.struct((-F.col("rate")).alias("r"), "event_type")).alias("b"))
    return best.select("day", "b.event_type", (-F.col("b.r")).alias("rate"))


def feeds_union(s, d):
    """Items of three tables under one schema, each with its category."""
    parts = (table(s, d, t).select(F.lit(t).alias("category"), F.col(i).cast("long").alias("id"), F.substring(c, 1, 200).alias("summary")) for t, i, c in (("benchmark", "item_id", "text"), ("pages", "page_id", "url"), ("nation", "n_nationkey", "n_name")))
    return reduce(DataFrame.unionByName, parts)


def topic_pick(s, d):
    """For each user the topic to bring up: of those not seen in the last 24 hours the one of highest priority, then most often seen."""
    events = table(s, d, "events").select("user_id", F.col("event_type").alias("topic"), "ts", "value")
    seen = events.groupBy("user_id", "topic").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("times"), F.max("value").alias("priority"))
    end = events.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("since"))
    old = seen.crossJoin(F.broadcast(end)).where("last < since")  # one row
    best = old.groupBy("user_id").agg(F.min(F.struct((-F.col("priority")).alias("a"), (-F.col("times")).alias("b"), "topic")).alias("t"))
    return best.select("user_id", "t.topic", (-F.col("t.b")).alias("times"))


def _quoted(words) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


_LANG = " ".join(f"WHEN regexp_matches(text, '[\\x{{{a}}}-\\x{{{b}}}]') THEN '{k}'" for k, a, b in rules.SCRIPTS) + " " + " ".join(f"WHEN {_quoted(w)} THEN '{k}'" for k, *w in rules.GREETINGS)
_HITS = f"SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL {TTL} SECOND, false) AS hit FROM events"
_PATTERNS = ", ".join(f"('{p}')" for p in PATTERNS)

QUERIES = {f.__name__: f for f in (
    import_json, import_csv, import_markdown, sink_replace_partition, sink_bounded_files, sink_log_by_day, think_strip, json_extract, inverted_abstract, lang_detect,
    dedup_base_id, dedup_literature, cache_ttl_hits, cache_hit_rate, source_cascade, low_load_hours, entity_fuzzy, entity_mentions, model_batch,
    labelled_fields, rerank_scores, semantic_dedup_greedy, entity_multi, review_candidates, best_source, feeds_union, topic_pick)}
ORACLE = {
    "import_json": "SELECT item_id, md5(text) AS digest FROM benchmark",
    "import_csv": "SELECT 'Item \"' || item_id || '\"' AS title, md5(text) AS digest, 'a|b' AS tags FROM benchmark",
    "import_markdown": "SELECT 'Item ' || item_id AS title, md5(text) AS digest, 'a, b' AS tags, 's' || item_id AS source FROM benchmark",
    "sink_replace_partition": "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS most FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 100000 GROUP BY ALL",
    "sink_bounded_files": "SELECT count(*) AS total, true AS bounded FROM documents",
    "sink_log_by_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL",
    "think_strip": r"SELECT conv_id, turn, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM conversations",
    "json_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "inverted_abstract": r"SELECT item_id, md5(regexp_replace(text, '\s+', ' ', 'g')) AS digest FROM benchmark",
    "lang_detect": f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL {_LANG} ELSE 'en' END AS lang_tag FROM documents",
    "dedup_base_id": "SELECT 'p' || label AS base, vec_id, CAST(embedding[1] AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings) WHERE r = 1",
    "dedup_literature": """SELECT min(page_id) AS page_id, key FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN url ELSE nullif(substring(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 50), '') END AS key FROM pages)
WHERE key IS NOT NULL GROUP BY key""",
    "cache_ttl_hits": _HITS,
    "cache_hit_rate": f"SELECT count(*) AS uses, count_if(hit)::BIGINT AS hits, printf('%.1f%%', avg(hit::INTEGER) * 100) AS rate FROM ({_HITS})",
    "source_cascade": f"""SELECT lang, tier, n, CAST(least(n, {WANTED} - seen) AS BIGINT) AS taken FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
FROM (SELECT lang, CASE WHEN source LIKE '%1' THEN 1 WHEN source LIKE '%5' THEN 2 ELSE 3 END AS tier, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL)) WHERE seen < {WANTED}""",
    "low_load_hours": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1 HAVING count(*) < 8",
    "entity_mentions": f"SELECT doc_id AS id, pattern, CAST((length(text) - length(replace(text, pattern, ''))) / length(pattern) AS BIGINT) AS times, strpos(text, pattern) AS first FROM documents JOIN (VALUES {_PATTERNS}) v(pattern) ON contains(text, pattern)",
    "model_batch": "SELECT item_id, CASE WHEN NOT contains(text, chr(10)) THEN upper(substring(text, 1, 20)) END AS reply, CASE WHEN contains(text, chr(10)) THEN 'ValueError: line end' END AS error FROM benchmark",
    "labelled_fields": "SELECT p_partkey, p_name AS name, p_brand AS brand, nullif(p_type, 'SMALL') AS category, CAST(p_size AS VARCHAR) AS price FROM part",
    "rerank_scores": "SELECT event_id, round(CAST(json_extract(props, '$.k') AS DOUBLE) / 10, 6) AS s0, CASE WHEN event_id % 2 = 0 THEN 0.7 ELSE 0.85 END::DOUBLE AS s1, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 5.0 END::DOUBLE AS s2 FROM events",
    "review_candidates": "SELECT user_id, event_type, count(*) AS times, max(value) >= 150 AND count(*) >= 10 AS approved FROM events GROUP BY ALL HAVING max(value) >= 100 AND count(*) >= 5 AND min(ts) < TIMESTAMP '2024-01-24'",
    "best_source": """SELECT day, event_type, rate FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY rate DESC, event_type) AS r
FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(avg((value > 50)::INTEGER), 6) AS rate FROM events GROUP BY ALL)) WHERE r = 1""",
    "feeds_union": "SELECT 'benchmark' AS category, CAST(item_id AS BIGINT) AS id, substring(text, 1, 200) AS summary FROM benchmark UNION ALL SELECT 'pages', page_id, substring(url, 1, 200) FROM pages UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_name FROM nation",
    "topic_pick": """SELECT user_id, topic, times FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, times DESC, topic) AS r FROM (SELECT user_id, event_type AS topic, max(ts) AS last, count(*) AS times, max(value) AS priority FROM events GROUP BY ALL)
WHERE last < (SELECT max(ts) - INTERVAL 24 HOUR FROM events)) WHERE r = 1""",
}
ORACLE["semantic_dedup_greedy"] = f"""WITH RECURSIVE pr AS (SELECT e.vec_id AS a, q.vec_id AS b FROM embeddings e JOIN embeddings q ON e.vec_id < q.vec_id AND {_COS} >= 0.3),
o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings WHERE vec_id IN (SELECT a FROM pr UNION SELECT b FROM pr)),
k AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL SELECT o.r, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.b = o.id AND list_contains(k.kept, pr.a)) THEN k.kept ELSE list_append(k.kept, o.id) END FROM k JOIN o ON o.r = k.r + 1),
z AS (SELECT kept FROM k ORDER BY r DESC LIMIT 1) SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM o) OR list_contains((SELECT kept FROM z), vec_id)"""
