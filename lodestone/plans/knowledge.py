"""The graph of customers and parts as knowledge: lookups, chunks, cut-outs, imports and short texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import graph, knowledge, vectors
from lodestone.plans.activity import _G, _graph
from lodestone.plans.retrieval import _COS, _searches
from lodestone.session import ship
from lodestone.sources.shared import new_folder, settled
from lodestone.sources.tables import table

ASKED = ["Brand#11", "brand#22 alias", "SMALL", "nothing"]


def _entities(s, d):
    """Parts as entities: type, synonyms and popularity by size."""
    part = table(s, d, "part")
    return part.select(
        F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_size").alias("popularity"), F.col("p_partkey").alias("place"),
        F.array("p_brand", F.concat("p_brand", F.lit(" Alias"))).alias("synonyms"))


def _links(s, d):
    """Orders as chunks of the parts in them."""
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("p"), "l_partkey").alias("id"))


def entity_exact(s, d):
    return knowledge.exact_entities(_entities(s, d), s.createDataFrame([(q,) for q in ASKED], "query string"))


def entity_by_type(s, d):
    return knowledge.entities_of_type(_entities(s, d), "PROMO", F.lit("ring")).select("entity_id", "name", "popularity", "place")


def entity_values(s, d):
    """Values of one type from an index of type:value entries."""
    index = table(s, d, "part").select(F.concat(F.lit("brand:"), "p_brand").alias("e")).union(table(s, d, "part").select(F.concat(F.lit("type:"), "p_type", F.lit(":x")))).distinct()
    return index.where("startswith(e, 'type:')").select(F.regexp_replace("e", "^type:", "").alias("value"))


def entity_stats(s, d):
    return _entities(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.size("synonyms")).alias("synonyms"))


def kg_khop_chunks(s, d):
    """Orders by the number of entities within one step of two customers."""
    found = knowledge.chunks_of_seeds(_graph(s, d), s.createDataFrame([("c1",), ("c2",)], "id string"), _links(s, d), 2, 20)
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderstatus").alias("content"))
    return found.join(orders, "chunk_id")


def kg_keyword_chunks(s, d):
    """Chunks by matched entities and relations; parts and customers stand for what a vector search matched."""
    local = _entities(s, d).where("type = 'PROMO' AND popularity > 40").select(F.col("entity_id").alias("id"), (F.col("popularity") / 50).alias("score"))
    relations = _graph(s, d).where("src IN ('c1', 'c4', 'c7')").withColumn("score", F.lit(0.75))
    return knowledge.chunks_of_keywords(local, relations, _links(s, d), 20)


def kg_around(s, d):
    kept, touched = knowledge.around(_entities(s, d).select("entity_id", "type"), _graph(s, d), "ECONOMY", 5)
    return kept.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("a"), F.col("type").alias("b")).union(touched.select(F.lit("relation"), "src", "dst"))


def kg_cut_out(s, d):
    """The first 60 nodes, parts and customers in turn, and the first 40 relations among them."""
    n = _entities(s, d).select("entity_id", "type", (F.col("place") * 2).alias("place")).union(
        table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.lit("customer"), F.col("c_custkey") * 2 + 1))
    kept, inner = knowledge.cut_out(n, _graph(s, d), None, 60, 40)
    return kept.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("a"), F.col("type").alias("b")).union(inner.select(F.lit("relation"), "src", "dst"))


def kg_merged(s, d):
    own = _entities(s, d).where("place % 2 = 0").groupBy("name").agg(F.max(F.col("popularity") / 50).alias("weight"))
    return knowledge.merged(own, _entities(s, d).where("place % 3 = 0").groupBy("name").agg(F.max(F.col("popularity") / 100).alias("weight")), True)


def kg_saved(s, d):
    """The graph written as four tables and counted after it is read again."""
    path = new_folder(s, "graph")
    entities = _entities(s, d)
    knowledge.save_graph(path, entities=entities, relations=_graph(s, d), chunk_entities=_links(s, d).distinct(), chunks=table(s, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_orderstatus"))
    found = knowledge.load_graph(s, path)
    total = lambda n: found[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
    out = total("entities")
    for name in knowledge.TABLES[1:]:
        out = out.union(total(name))
    return out


def import_joined(s, d):
    """Documents with the vector of their key imported, the others counted as skipped, by language."""
    own = table(s, d, "documents").select("lang", (F.col("doc_id") * 2).alias("vec_id")).join(table(s, d, "embeddings").select("vec_id", F.lit(True).alias("has")), "vec_id", "left")
    return own.groupBy("lang").agg(F.count_if("has").alias("imported"), F.count_if(F.col("has").isNull()).alias("skipped"))


def product_text(s, d):
    """Texts to embed: brand, name and tags; title, category and 200 characters without line ends."""
    a = table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_name", F.nullif("p_type", F.lit("SMALL"))).alias("text"))
    b = table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id"), F.concat_ws(" ", F.concat(F.lit("T"), "doc_id"), "lang", F.translate(F.substring("text", 1, 200), "\n", " ")))
    return a.union(b).select("id", F.md5("text").alias("digest"))


def brand_groups(s, d):
    """Brands by a table of canonical names, else themselves."""
    canon = s.createDataFrame([("Brand#11", "One"), ("Brand#12", "One"), ("Brand#21", "Two")], "p_brand string, canon string")
    return table(s, d, "part").join(F.broadcast(canon), "p_brand", "left").groupBy(F.coalesce("canon", "p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))


def list_limited(s, d):
    """Parts of distinct brand and name, the first fifty by key."""
    return table(s, d, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("p_partkey")).orderBy("p_partkey").limit(50)


def ids_by_prefix(s, d):
    """How many keys of each kind, told by their prefix."""
    ids = _entities(s, d).select("entity_id").union(table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey")))
    return ids.agg(F.count_if(F.col("entity_id").startswith("p")).alias("products"), F.count_if(F.col("entity_id").startswith("c")).alias("customers"), F.count(F.lit(1)).alias("total"))


def layer_search(s, d):
    """Documents of given layers that contain the word, by quality and id, the first twenty."""
    own = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").where(F.col("lang").isin("en", "fr") & F.lower("text").contains("the"))
    return own.orderBy(F.desc("quality"), "doc_id").limit(20).select("doc_id", "lang", "quality")


def titles_by_source(s, d):
    """Pages whose title has the word, in a bucket by host, the first three of each, joined."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    host = F.when(F.col("url").contains(".org"), "org").when(F.col("url").contains(".net"), "net").otherwise("other")
    own = table(s, d, "pages").select("page_id", title.alias("title"), host.alias("host")).where(F.lower("title").contains("e"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("page_id", "title"))), 1, 3)
    best = own.withColumn("r", F.row_number().over(W.partitionBy("host").orderBy("page_id"))).where("r <= 3")
    return best.groupBy("host").agg(F.array_join(F.transform(first, lambda x: x["title"]), " | ").alias("titles"))


def kg_degree_table(s, d):
    """How many entities have each degree, and the mean."""
    found = graph.degrees(_graph(s, d))
    return found.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def vector_neighbours(s, d):
    """The five nearest vectors of each vector of the bank, itself left out: a graph of neighbours, with distances."""
    ship(s)
    scored = vectors.score_queries(table(s, d, "embeddings").drop("label"), _searches(s, d), k=6).where("id <> query_id")
    return vectors.top_k(scored, 5, "query_id").select("query_id", "id", F.round(1 - F.col("score"), 6).alias("distance"), "rank")


def crawl(s, d):
    """Pages reached from the first page by links in at most two steps, by the links' targets among the pages."""
    pages = settled(table(s, d, "pages").select("page_id", "url", F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1)).alias("links")))
    edges = pages.select("url", F.explode("links").alias("target")).join(pages.select(F.col("url").alias("target")).distinct(), "target", "left_semi")
    found = graph.k_hop(edges.select(F.col("url").alias("src"), F.col("target").alias("dst")), pages.where("page_id = 1").select(F.col("url").alias("id")), 2)
    return found.select(F.col("id").alias("url"), "hop")


_K = f"{_G}, b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), l AS (SELECT DISTINCT l_orderkey AS chunk_id, 'p' || l_partkey AS id FROM lineitem)"

QUERIES = {f.__name__: f for f in (
    entity_exact, entity_by_type, entity_values, entity_stats, kg_khop_chunks, kg_keyword_chunks, kg_around, kg_cut_out, kg_merged, kg_saved, import_joined, product_text, brand_groups, list_limited, ids_by_prefix,
    layer_search, titles_by_source, kg_degree_table, vector_neighbours, crawl)}
ORACLE = {
    "entity_exact": "SELECT q AS query, 'p' || p_partkey AS entity_id, p_size AS popularity FROM part JOIN (VALUES ('Brand#11'), ('brand#22 alias'), ('SMALL'), ('nothing')) v(q) ON lower(q) IN (lower(p_name), lower(p_brand), lower(p_brand || ' Alias'))",
    "entity_by_type": "SELECT 'p' || p_partkey AS entity_id, p_name AS name, p_size AS popularity, CAST(row_number() OVER (ORDER BY p_size DESC, 'p' || p_partkey) AS INTEGER) AS place FROM part WHERE p_type = 'PROMO' AND (contains(lower(p_name), 'ring') OR contains('ring', lower(p_name)))",
    "entity_values": "SELECT DISTINCT p_type || ':x' AS value FROM part",
    "entity_stats": "SELECT p_type AS type, count(*) AS entities, count(*) * 2 AS synonyms FROM part GROUP BY 1",
    "kg_khop_chunks": f"""WITH {_K}, h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN ('c1', 'c2')), r AS (SELECT unnest(['c1', 'c2']) AS id UNION SELECT id FROM h1 UNION SELECT dst FROM b WHERE src IN (SELECT id FROM h1)),
t AS (SELECT chunk_id, count(*) AS score FROM l JOIN r USING (id) GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 20) SELECT chunk_id, score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS place, o_orderstatus AS content FROM t JOIN orders ON o_orderkey = chunk_id""",
    "kg_keyword_chunks": f"""WITH {_K}, e AS (SELECT 'p' || p_partkey AS id, p_size / 50 AS score FROM part WHERE p_type = 'PROMO' AND p_size > 40 UNION ALL SELECT src, 0.75::DOUBLE FROM g WHERE src IN ('c1', 'c4', 'c7') UNION ALL SELECT dst, 0.75 FROM g WHERE src IN ('c1', 'c4', 'c7')),
m AS (SELECT id, max(score) AS score FROM e GROUP BY id), t AS (SELECT chunk_id, round(sum(score), 6) AS score FROM l JOIN m USING (id) GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 20) SELECT chunk_id, score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS place FROM t""",
    "kg_around": f"""WITH {_G}, k AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_type = 'ECONOMY' ORDER BY 1 LIMIT 5) SELECT 'entity' AS kind, id AS a, 'ECONOMY' AS b FROM k UNION ALL SELECT 'relation', src, dst FROM g WHERE src IN (SELECT id FROM k) OR dst IN (SELECT id FROM k)""",
    "kg_cut_out": f"""WITH {_G}, k AS (SELECT * FROM (SELECT 'p' || p_partkey AS id, p_type AS t, p_partkey * 2 AS place FROM part UNION ALL SELECT 'c' || c_custkey, 'customer', c_custkey * 2 + 1 FROM customer) ORDER BY place LIMIT 60)
SELECT 'entity' AS kind, id AS a, t AS b FROM k UNION ALL SELECT * FROM (SELECT 'relation', src, dst FROM g WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) ORDER BY src, dst LIMIT 40)""",
    "kg_merged": """WITH a AS (SELECT p_name AS name, max(p_size / 50) AS w FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT p_name AS name, max(p_size / 100) AS v FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT name, round(CASE WHEN w IS NOT NULL AND v IS NOT NULL THEN (w + v) / 2 ELSE coalesce(w, v) END, 6) AS weight FROM a FULL JOIN b USING (name)""",
    "kg_saved": f"WITH {_K} SELECT 'entities' AS name, count(*) AS n FROM part UNION ALL SELECT 'relations', count(*) FROM g UNION ALL SELECT 'chunk_entities', count(*) FROM l UNION ALL SELECT 'chunks', count(*) FROM orders",
    "import_joined": "SELECT lang, CAST(count_if(vec_id IS NOT NULL) AS BIGINT) AS imported, CAST(count_if(vec_id IS NULL) AS BIGINT) AS skipped FROM documents LEFT JOIN embeddings ON vec_id = doc_id * 2 GROUP BY lang",
    "product_text": "SELECT 'p' || p_partkey AS id, md5(concat_ws(' ', p_brand, p_name, nullif(p_type, 'SMALL'))) AS digest FROM part UNION ALL SELECT 'd' || doc_id, md5(concat_ws(' ', 'T' || doc_id, lang, replace(substring(text, 1, 200), chr(10), ' '))) FROM documents",
    "brand_groups": "SELECT CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'One' WHEN p_brand = 'Brand#21' THEN 'Two' ELSE p_brand END AS brand, count(*) AS n FROM part GROUP BY 1",
    "list_limited": "SELECT p_brand, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY ALL ORDER BY 3 LIMIT 50",
    "ids_by_prefix": "SELECT (SELECT count(*) FROM part) AS products, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM part) + (SELECT count(*) FROM customer) AS total",
    "layer_search": "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr') AND contains(lower(text), 'the') ORDER BY quality DESC, doc_id LIMIT 20",
    "titles_by_source": """SELECT host, string_agg(title, ' | ' ORDER BY page_id) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r FROM (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
CASE WHEN contains(url, '.org') THEN 'org' WHEN contains(url, '.net') THEN 'net' ELSE 'other' END AS host FROM pages) WHERE contains(lower(title), 'e')) WHERE r <= 3 GROUP BY host""",
    "kg_degree_table": f"WITH {_G}, x AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) GROUP BY id) SELECT degree, count(*) AS n FROM x GROUP BY degree",
    "vector_neighbours": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, id, round(1 - score, 6) AS distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""",
    "crawl": """WITH p AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS links FROM pages), e AS (SELECT DISTINCT url AS src, t AS dst FROM (SELECT url, unnest(links) AS t FROM p) WHERE t IN (SELECT url FROM pages)), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
h0 AS (SELECT DISTINCT url AS id FROM p WHERE page_id = 1), h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN (SELECT id FROM h0)), h2 AS (SELECT DISTINCT dst AS id FROM b WHERE src IN (SELECT id FROM h1)), a AS (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) SELECT id AS url, min(hop) AS hop FROM a GROUP BY id""",
}
