"""Vector search, fusion, constraints and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import bm25, constraints, fusion, vectors
from lodestone.plans import lexical
from lodestone.session import ship
from lodestone.sources.shared import settled
from lodestone.sources.table_tools import authority, token_estimate
from lodestone.sources.tables import table

LEAST = 0.3


def _vec(s, d):
    return table(s, d, "embeddings")


def _searches(s, d):
    """The agreed queries: every vector whose id is divisible by 20."""
    return _vec(s, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def _scored(s, d, **more):
    ship(s)
    return vectors.score_queries(_vec(s, d), _searches(s, d), **more)


def vector_topk(s, d):
    return vectors.top_k(_scored(s, d, k=10).drop("label"), 10, "query_id")


def vector_topk_by_label(s, d):
    return vectors.top_k(_scored(s, d, k=2, by="label"), 2, "query_id", "label")


def vector_threshold(s, d):
    return _scored(s, d, least=LEAST)


def vector_best_match(s, d):
    """Arg-max of each other vector over the bank of those divisible by 20, at or above the threshold."""
    bank = _scored(s, d, least=LEAST, nearest=True).where("id % 20 <> 0")
    best = bank.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("n"), "query_id")).alias("b"))
    return best.select("id", F.col("b.query_id").alias("bank_id"), (-F.col("b.n")).alias("score"))


def vector_insert_filter(s, d):
    """Vectors that no vector of the bank resembles: the largest cosine is at most the threshold."""
    return _scored(s, d, nearest=True).where("id % 20 <> 0").groupBy("id").agg(F.max("score").alias("nearest")).where(F.col("nearest") <= LEAST)


def vector_pairs_similar(s, d):
    return vectors.similar_pairs(_vec(s, d).select("vec_id", "embedding"), LEAST)


def vector_ann_recall(s, d):
    """Whether the index finds at least 0.9 of the exact ten nearest of all queries."""
    exact = settled(vector_topk(s, d).select("query_id", "id"))
    near = vectors.ann_top_k(_vec(s, d), _searches(s, d), 10, lists=8, probes=6).select("query_id", "id")
    hit = exact.join(near, ["query_id", "id"], "left_semi").count()
    return s.createDataFrame([(hit >= 0.9 * exact.count(),)], "recall_ok boolean")


def _paths(s, d):
    """For each query vector its nearest vectors, and the best documents for one of the phrases."""
    vec = vectors.top_k(_scored(s, d, k=20).drop("label"), 20, "query_id").select("query_id", "id", "rank", "score")
    phrase = F.element_at(F.array(*[F.lit(q) for _, q in lexical.SEARCHES]), (F.floor(F.col("query_id") / 20) % len(lexical.SEARCHES) + 1).cast("int"))
    lex = bm25.bm25_search(lexical._docs(s, d), _searches(s, d).select("query_id", phrase.alias("query")), 20)
    return settled(vec), settled(lex.select("query_id", "id", "rank", "score"))


def rrf_multi_path(s, d):
    vec, lex = _paths(s, d)
    ranked = vec.withColumn("path", F.lit("vector")).unionByName(lex.withColumn("path", F.lit("bm25")))
    return fusion.rrf(ranked, {"vector": 1.0, "bm25": 0.9})


def hybrid_merge(s, d):
    vec, lex = _paths(s, d)
    scaled = [fusion.min_max(x.select("query_id", "id", "score"), "query_id").select("query_id", "id", F.col("scaled").alias("score")) for x in (vec, lex)]
    return fusion.merge_scores(*scaled)


def minmax_scores(s, d):
    return fusion.min_max(vector_topk(s, d), "query_id").select("query_id", "id", "score", "scaled")


def _part(s, d):
    return table(s, d, "part")


#: One constraint for each operator, over ``part``.
CONSTRAINTS = {
    "eq": ("p_size", "eq", 10, "p_size = 10"), "ne": ("p_brand", "ne", "Brand#11", "p_brand <> 'Brand#11'"),
    "gt": ("p_retailprice", "gt", 1500.0, "p_retailprice > 1500"), "gte": ("p_size", "gte", 45, "p_size >= 45"),
    "lt": ("p_retailprice", "lt", 950.0, "p_retailprice < 950"), "lte": ("p_size", "lte", 3, "p_size <= 3"),
    "in": ("p_size", "in", [1, 2, 50], "p_size IN (1, 2, 50)"), "nin": ("p_size", "nin", [1, 2, 3], "p_size NOT IN (1, 2, 3)"),
    "contains": ("p_name", "contains", "ring", "contains(p_name, 'ring')"),
    "startswith": ("p_name", "startswith", "small", "starts_with(p_name, 'small')"),
    "endswith": ("p_name", "endswith", "ring", "ends_with(p_name, 'ring')"),
}


def _constraint(name):
    return lambda s, d: constraints.constrain(_part(s, d), [CONSTRAINTS[name][:3]]).select("p_partkey")


def metadata_filter(s, d):
    return constraints.filter_dict(_part(s, d), {"p_size": {"gte": 10, "lt": 30}, "p_name": {"contains": "r"}}).select("p_partkey", "p_name")


def list_page(s, d):
    return constraints.page(_part(s, d).select("p_partkey", "p_name"), 3, 20, "p_partkey")


def list_facets(s, d):
    p = _part(s, d)
    return p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("avg_price"))


def keyword_search(s, d):
    key = "ring"
    p = _part(s, d)
    return p.where(F.lower("p_name").contains(key) | F.lower("p_brand").contains(key) | F.lower("p_type").contains(key)).select("p_partkey", "p_name")


def enrich_group(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    return table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(
        r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


def entity_retrieve(s, d):
    """Entity index joined with weighted query entities: sum of weights by part."""
    entities = _part(s, d).select(F.col("p_partkey").alias("id"), F.explode(F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("category:"), "p_type"))).alias("entity"))
    asked = s.createDataFrame([("brand:Brand#11", 0.8), ("brand:Brand#22", 0.8), ("category:SMALL", 0.7), ("category:ECONOMY", 0.7)], "entity string, weight double")
    return entities.join(F.broadcast(asked), "entity").groupBy("id").agg(F.round(F.sum("weight"), 6).alias("score"))


def token_counts(s, d):
    return table(s, d, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def token_budget_prefix(s, d):
    docs = table(s, d, "documents").select("source", "doc_id", token_estimate(F.col("text")).alias("tokens"))
    return fusion.budget_prefix(docs, 4000, ["source"], ["doc_id"]).select("source", "doc_id", "tokens", "used")


def context_priority(s, d):
    """Labelled documents by 0.3 of their source's authority and 0.7 of quality."""
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    rank = F.round(authority(F.col("source")) * 0.3 + F.col("quality") * 0.7, 6)
    return docs.select("doc_id", "source", rank.alias("priority"))


_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_S = "scored AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, " + _COS + " AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"
_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank"
_PHRASES = ", ".join(f"({i}, '{q}')" for i, (_, q) in enumerate(lexical.SEARCHES))
_LEX = lexical.ORACLE["bm25_topk"].replace("<= 10", "<= 20").replace(
    lexical._ASKED, f"q AS (SELECT vec_id AS query_id, unnest(string_split(lower(query), ' ')) AS term FROM embeddings JOIN (VALUES {_PHRASES}) v(k, query) ON (vec_id // 20) % {len(lexical.SEARCHES)} = k WHERE vec_id % 20 = 0)"
)
_PATHS = f"WITH {_S}, vec AS (SELECT * FROM (SELECT query_id, id, score, {_RANK} FROM scored) WHERE rank <= 20), lex AS ({_LEX})"
_TOK = r"(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(regexp_replace(text, '[^\x{4e00}-\x{10ffff}]', '', 'g')) / 2.0 + (length(text) - length(regexp_replace(text, '[^\x{4e00}-\x{10ffff}]', '', 'g'))) / 4.0) AS BIGINT)) END)"

QUERIES = {f.__name__: f for f in (
    vector_topk, vector_topk_by_label, vector_threshold, vector_best_match, vector_insert_filter, vector_pairs_similar, vector_ann_recall,
    rrf_multi_path, hybrid_merge, minmax_scores, metadata_filter, list_page, list_facets, keyword_search, enrich_group, entity_retrieve,
    token_counts, token_budget_prefix, context_priority)}
QUERIES |= {f"constraint_filter_{k}": _constraint(k) for k in CONSTRAINTS}
ORACLE = {
    "vector_topk": f"WITH {_S} SELECT query_id, id, score, rank FROM (SELECT *, {_RANK} FROM scored) WHERE rank <= 10",
    "vector_topk_by_label": f"WITH {_S} SELECT * FROM (SELECT *, {_RANK.replace('query_id ORDER', 'query_id, label ORDER')} FROM scored) WHERE rank <= 2",
    "vector_threshold": f"WITH {_S} SELECT * FROM scored WHERE score >= 0.3",
    "vector_best_match": f"WITH {_S} SELECT id, query_id AS bank_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, query_id) AS r FROM scored WHERE id % 20 <> 0) WHERE r = 1 AND score >= 0.3",
    "vector_insert_filter": f"WITH {_S} SELECT id, max(score) AS nearest FROM scored WHERE id % 20 <> 0 GROUP BY id HAVING max(score) <= 0.3",
    "vector_ann_recall": "SELECT true AS recall_ok",
    "vector_pairs_similar": f"SELECT * FROM (SELECT e.vec_id AS a, q.vec_id AS b, {_COS} AS score FROM embeddings e JOIN embeddings q ON e.vec_id < q.vec_id) WHERE score >= 0.3",
    "rrf_multi_path": f"{_PATHS} SELECT query_id, id, round(sum(w / (60 + rank)), 9) AS score, count(*) AS paths FROM (SELECT query_id, id, rank, 1.0::DOUBLE AS w FROM vec UNION ALL SELECT query_id, id, rank, 0.9::DOUBLE FROM lex) GROUP BY ALL",
    "hybrid_merge": f"""{_PATHS}, a AS (SELECT query_id, id, round(CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 1.0 END, 6) AS s FROM vec WINDOW p AS (PARTITION BY query_id)),
b AS (SELECT query_id, id, round(CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 1.0 END, 6) AS s FROM lex WINDOW p AS (PARTITION BY query_id))
SELECT query_id, id, round(coalesce(a.s, 0) * 0.4::DOUBLE + coalesce(b.s, 0) * 0.6::DOUBLE, 6) AS score FROM a FULL JOIN b USING (query_id, id)""",
    "minmax_scores": f"WITH {_S}, t AS (SELECT * FROM (SELECT *, {_RANK} FROM scored) WHERE rank <= 10) SELECT query_id, id, score, round(CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 1.0 END, 6) AS scaled FROM t WINDOW p AS (PARTITION BY query_id)",
    "metadata_filter": "SELECT p_partkey, p_name FROM part WHERE p_size >= 10 AND p_size < 30 AND contains(p_name, 'r')",
    "list_page": "SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS total, CAST(ceil((SELECT count(*) FROM part) / 20.0) AS BIGINT) AS pages, 3 < ceil((SELECT count(*) FROM part) / 20.0) AS has_next FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40",
    "list_facets": "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS avg_price FROM part GROUP BY p_brand",
    "keyword_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')",
    "enrich_group": "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "entity_retrieve": "WITH e AS (SELECT p_partkey AS id, unnest(['brand:' || p_brand, 'category:' || p_type]) AS entity FROM part) SELECT id, round(sum(weight), 6) AS score FROM e JOIN (VALUES ('brand:Brand#11', 0.8::DOUBLE), ('brand:Brand#22', 0.8::DOUBLE), ('category:SMALL', 0.7::DOUBLE), ('category:ECONOMY', 0.7::DOUBLE)) q(entity, weight) USING (entity) GROUP BY id",
    "token_counts": f"SELECT doc_id, {_TOK} AS tokens FROM documents",
    "token_budget_prefix": f"SELECT source, doc_id, tokens, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM (SELECT source, doc_id, {_TOK} AS tokens FROM documents)) WHERE used <= 4000",
    "context_priority": "SELECT doc_id, source, round((CASE WHEN source LIKE '%1' THEN 0.95 WHEN source LIKE '%5' THEN 0.8 ELSE 0.5 END)::DOUBLE * 0.3::DOUBLE + quality * 0.7::DOUBLE, 6) AS priority FROM documents JOIN labels USING (doc_id)",
} | {f"constraint_filter_{k}": f"SELECT p_partkey FROM part WHERE {v[3]}" for k, v in CONSTRAINTS.items()}
