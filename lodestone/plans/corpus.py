"""Duplicates, moderation, chunking, rules and hygiene over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import words
from lodestone.operators import chunking, dedup, moderation
from lodestone.sources.table_tools import token_estimate
from lodestone.sources.tables import table


def _docs(s, d):
    return table(s, d, "documents")


def dedup_exact(s, d):
    docs = _docs(s, d).select("doc_id", "source", F.md5(dedup.normalised(F.col("text"))).alias("h"))
    return dedup.first_by(docs, F.col("h"), "doc_id", ["source"])


def dedup_key_first(s, d):
    return dedup.first_by(table(s, d, "part"), F.concat_ws("|", "p_brand", "p_name"), "p_partkey", ["p_name", "p_brand"])


def dedup_best_score(s, d):
    return dedup.best_by(table(s, d, "part"), F.col("p_name"), "p_retailprice", "p_partkey")


def duplicate_counts(s, d):
    """Groups of equal texts and the rows that could go."""
    groups = _docs(s, d).groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removable"))


def _rules(s):
    return s.createDataFrame(moderation.RULES, "keyword string, category string, code string")


def moderation_details(s, d):
    return moderation.detections(_docs(s, d), _rules(s))


def moderation_verdict(s, d):
    return moderation.verdicts(moderation_details(s, d))


def moderation_codes(s, d):
    return moderation_details(s, d).groupBy("code").agg(F.countDistinct("id").alias("docs"))


def moderation_categories(s, d):
    return moderation_details(s, d).groupBy("id", "category").agg(F.array_join(F.sort_array(F.collect_set("keyword")), ",").alias("keywords"))


def question_bank_match(s, d):
    """Benchmark items that occur word for word."""
    return moderation.contained(_docs(s, d).select("doc_id", "text"), table(s, d, "benchmark"))


def sentence_split(s, d):
    found = chunking.sentences(F.col("text"))
    return _docs(s, d).select("doc_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|")).alias("digest"))


def chunk_grid(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(chunking.windows(F.col("text"), 512, 64)).alias("pos", "c")).select("doc_id", "pos", F.md5("c").alias("digest"))


def chunk_summary(s, d):
    t = _docs(s, d).select("lang", token_estimate(F.col("text")).alias("tokens"))
    band = F.when(F.col("tokens") <= 100, "short").when(F.col("tokens") <= 300, "medium").otherwise("long")
    return t.groupBy("lang", band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("tokens"), 4).alias("mean"), F.min("tokens").alias("least"), F.max("tokens").alias("most"))


def keyword_jaccard(s, d):
    """Jaccard of distinct words of neighbouring documents."""
    own = _docs(s, d).select("doc_id", F.array_distinct(words(F.col("text"))).alias("w"))
    nxt = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    both = own.join(nxt, "doc_id")
    shared = F.size(F.array_intersect("w", "v"))
    joint = F.size("w") + F.size("v") - shared
    return both.select("doc_id", F.round(F.when(joint > 0, shared / joint).otherwise(0.0), 6).alias("jaccard"))


def keyword_md5(s, d):
    return _docs(s, d).select("doc_id", F.md5(F.array_join(F.array_sort(F.array_distinct(words(F.col("text")))), "|")).alias("h"))


def ids_md5(s, d):
    return table(s, d, "part").select("p_partkey", F.concat(F.lit("entity_"), F.substring(F.md5("p_name"), 1, 8)).alias("entity_id"),
                                      F.concat(F.lit("relation_"), F.substring(F.md5(F.concat_ws("_", "p_brand", "p_name", "p_type")), 1, 8)).alias("relation_id"))


def clean_text(s, d):
    """Trimmed, NUL and replacement characters dropped, cut to 8192, a placeholder if empty."""
    flat = F.substring(F.trim(F.regexp_replace("text", "[\\x00�]", "")), 1, 8192)
    return _docs(s, d).select("doc_id", F.md5(F.when(flat == "", "empty").otherwise(flat)).alias("h"))


def emotion_rules(s, d):
    """Class of most keyword hits (first class on ties), intensity 0.3 a hit up to 1."""
    text = F.lower("text")
    hits = [sum(F.when(text.contains(k), 1).otherwise(0) for k in ks) for ks in (("pathetic", "worthless"), ("licensed", "blend"), ("token", "heit"))]
    best = F.greatest(*hits)
    label = F.when(best == 0, "neutral").when(hits[0] == best, "negative").when(hits[1] == best, "positive").otherwise("technical")
    return _docs(s, d).select("doc_id", label.alias("emotion"), F.round(F.when(best == 0, 0.3).otherwise(F.least(F.lit(1.0), best * 0.3)), 6).alias("intensity"))


def quality_gate(s, d):
    return _docs(s, d).join(table(s, d, "labels"), "doc_id").where("length(text) >= 50 AND quality = 1 AND toxic = 0").select("doc_id")


def html_title(s, d):
    return table(s, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


def html_links(s, d):
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return table(s, d, "pages").select("page_id", F.size(links).alias("n"), F.array_join(F.array_sort(F.array_distinct(links)), " ").alias("links"))


def html_text(s, d):
    bare = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>", " ")
    return table(s, d, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(bare, r"\s+", " "))).alias("digest"))


def content_valid(s, d):
    return table(s, d, "pages").where(~F.lower("html").contains("access denied") & (F.length("html") >= 50)).select("page_id")


def trending_classify(s, d):
    """Titles by category keyword: one row for each category that a title contains."""
    rules = s.createDataFrame([("en", "the "), ("fr", " de "), ("de", "ung"), ("es", "ción")], "category string, word string")
    titles = html_title(s, d)
    return titles.join(F.broadcast(rules), F.lower("title").contains(F.col("word"))).select("page_id", "category")


def resume_anti_join(s, d):
    return _docs(s, d).join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


_SENT = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]*[.!?\n]|[^.!?\n]+$'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_RULES = ", ".join(f"('{k}', '{c}', '{n}')" for k, c, n in moderation.RULES)
_DET = f"det AS (SELECT doc_id AS id, keyword, category, code FROM documents JOIN (VALUES {_RULES}) r(keyword, category, code) ON contains(lower(text), keyword))"
_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^\p{L}\p{N}_ ]', '', 'g'))"
_TOK = "(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 4.0) AS BIGINT)) END)"


def _contains(*keys):
    return " + ".join(f"CAST(contains(lower(text), '{k}') AS INTEGER)" for k in keys)


QUERIES = {f.__name__: f for f in (
    dedup_exact, dedup_key_first, dedup_best_score, duplicate_counts, moderation_details, moderation_verdict, moderation_codes, moderation_categories,
    question_bank_match, sentence_split, chunk_grid, chunk_summary, keyword_jaccard, keyword_md5, ids_md5, clean_text, emotion_rules,
    quality_gate, html_title, html_links, html_text, content_valid, trending_classify, resume_anti_join)}
ORACLE = {
    "dedup_exact": f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5({_NORM}) ORDER BY doc_id) AS r FROM documents) WHERE r = 1",
    "dedup_key_first": "SELECT p_partkey, p_name, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1",
    "dedup_best_score": "SELECT p_name AS key, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1",
    "duplicate_counts": "SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS removable FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)",
    "moderation_details": f"WITH {_DET} SELECT * FROM det",
    "moderation_verdict": f"WITH {_DET} SELECT id, 'C' || min(CAST(code[2:] AS INTEGER)) AS code, count(DISTINCT category) AS categories FROM det GROUP BY id",
    "moderation_codes": f"WITH {_DET} SELECT code, count(DISTINCT id) AS docs FROM det GROUP BY code",
    "moderation_categories": f"WITH {_DET} SELECT id, category, array_to_string(list_sort(list(DISTINCT keyword)), ',') AS keywords FROM det GROUP BY id, category",
    "question_bank_match": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "sentence_split": f"SELECT doc_id, CAST(len({_SENT}) AS INTEGER) AS n, md5(array_to_string({_SENT}, '|')) AS digest FROM documents",
    "chunk_grid": "SELECT doc_id, CAST(i AS INTEGER) AS pos, md5(substring(text, i * 448 + 1, 512)) AS digest FROM (SELECT doc_id, text, unnest(range(greatest(1, CAST(ceil((length(text) - 64) / 448.0) AS INTEGER)))) AS i FROM documents)",
    "chunk_summary": f"SELECT lang, CASE WHEN t <= 100 THEN 'short' WHEN t <= 300 THEN 'medium' ELSE 'long' END AS band, count(*) AS n, round(avg(t), 4) AS mean, min(t) AS least, max(t) AS most FROM (SELECT lang, {_TOK} AS t FROM documents) GROUP BY ALL",
    "keyword_jaccard": f"WITH w AS (SELECT doc_id, list_distinct({_W}) AS w FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.w) + len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE ELSE 0 END, 6) AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1",
    "keyword_md5": f"SELECT doc_id, md5(array_to_string(list_sort(list_distinct({_W})), '|')) AS h FROM documents",
    "ids_md5": "SELECT p_partkey, 'entity_' || md5(p_name)[:8] AS entity_id, 'relation_' || md5(p_brand || '_' || p_name || '_' || p_type)[:8] AS relation_id FROM part",
    "clean_text": "SELECT doc_id, md5(CASE WHEN trim(text) = '' THEN 'empty' ELSE substring(trim(text), 1, 8192) END) AS h FROM documents",
    "emotion_rules": f"""SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'neutral' WHEN a = greatest(a, b, c) THEN 'negative' WHEN b = greatest(a, b, c) THEN 'positive' ELSE 'technical' END AS emotion,
round(CASE WHEN greatest(a, b, c) = 0 THEN 0.3 ELSE least(1.0, greatest(a, b, c) * 0.3) END::DOUBLE, 6) AS intensity
FROM (SELECT doc_id, {_contains('pathetic', 'worthless')} AS a, {_contains('licensed', 'blend')} AS b, {_contains('token', 'heit')} AS c FROM documents)""",
    "quality_gate": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE length(text) >= 50 AND quality = 1 AND toxic = 0",
    "html_title": "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages",
    "html_links": """SELECT page_id, CAST(len(l) AS INTEGER) AS n, array_to_string(list_sort(list_distinct(l)), ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""",
    "html_text": r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages",
    "content_valid": "SELECT page_id FROM pages WHERE NOT contains(lower(html), 'access denied') AND length(html) >= 50",
    "trending_classify": "SELECT page_id, category FROM pages JOIN (VALUES ('en', 'the '), ('fr', ' de '), ('de', 'ung'), ('es', 'ción')) r(category, word) ON contains(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), word)",
    "resume_anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
