"""Banks, stores by text, layers and updates over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import banks, vectors
from lodestone.session import ship
from lodestone.sources.shared import new_folder
from lodestone.sources.tables import table

THRESHOLDS = {"C35": 0.25, "C36": 0.3, "C37": 0.2, "C38": 0.25, "C39": 0.4}
SURE = 0.35


def question_bank(s, d):
    """Items, vendors and benchmark texts as three sheets of one bank, by sheet and code."""
    sheets = {
        "items": (table(s, d, "items"), {"question": "concat(' ', name, ' ', kind)", "risk": "brand", "code": "'C35'"}),
        "vendors": (table(s, d, "vendors"), {"question": "name", "code": "concat('C', 36 + vendor_id % 3)"}),
        "benchmark": (table(s, d, "benchmark"), {"question": "text", "risk": "'b'"}),
    }
    made = banks.kept_once(s, banks.bank(sheets), "bank")
    return made.groupBy("sheet", "code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("question").alias("questions"), F.count("risk").alias("risks"))


def _matched(s, d):
    """Every twentieth vector asks a bank of all others, whose codes go by label and id."""
    ship(s)
    every = table(s, d, "embeddings")
    bank = every.where("vec_id % 20 <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.concat(F.lit("C"), F.lit(35) + (F.col("label") + F.col("vec_id")) % 5).alias("code"))
    asked = every.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return banks.best_questions(bank, asked, THRESHOLDS)


def question_bank_semantic(s, d):
    return _matched(s, d)


def blocked_candidates(s, d):
    """What the bank blocks, and how many of it are candidates, by code."""
    blocked, candidates = banks.blocked_and_candidates(_matched(s, d), ["C35", "C36", "C38"], SURE, s)
    both = blocked.groupBy("code").agg(F.count(F.lit(1)).alias("blocked")).join(candidates.groupBy("code").agg(F.count(F.lit(1)).alias("candidates")), "code", "left")
    return both.select("code", "blocked", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def _store(s, d):
    """Clicks' kinds and items' texts with the vector of their number, kept in three parts of which later ones win."""
    vec = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    path = new_folder(s, "store")
    for part in range(3):
        own = table(s, d, "items").where(F.col("item_id") % (part + 1) == 0).select(F.concat_ws(" ", "name", "kind").alias("text"), (F.col("item_id") + part).alias("vec_id"), F.col("brand").alias("source"))
        banks.save_store(own.groupBy("text", "source").agg(F.min("vec_id").alias("vec_id")).join(vec, "vec_id").withColumn("part", F.lit(part)), path, "part")
    return path


def store_parts(s, d):
    """The store read again: of each text the row of the last part, of that the one with the greatest vector number."""
    return banks.load_store(s, _store(s, d), "part").select("text", "part", "vec_id", "source")


def store_manifest(s, d):
    found = banks.manifest(s, _store(s, d), "part", "source")
    return found.select(F.col("part").cast("int").alias("part"), "source", "rows", (F.col("files") > 0).alias("has_files"))


def store_export(s, d):
    """The store exported as JSON and read again."""
    folder = new_folder(s, "export")
    banks.load_store(s, _store(s, d), "part").select("text", "part", "vec_id", "source").write.json(folder)
    back = s.read.schema("text string, part int, vec_id long, source string").json(folder)
    return back.select("text", "part", "vec_id", "source")


def store_similarity(s, d):
    """Similarity of each item's text with the next one's, by what the store has of both."""
    own = banks.load_store(s, _store(s, d), "part").select("text", "vec")
    items = table(s, d, "items").select("item_id", F.concat_ws(" ", "name", "kind").alias("one"), F.concat_ws(" ", "kind", "name").alias("swapped"))
    pairs = items.join(items.select((F.col("item_id") - 1).alias("item_id"), F.col("one").alias("next")), "item_id")
    pairs = pairs.select("item_id", "one", F.when(F.col("item_id") % 7 == 0, F.col("swapped")).otherwise(F.col("next")).alias("two"))
    return banks.similarity_of(pairs, own, "one", "two").select("item_id", "score")


def chunks_saved(s, d):
    """Chunks as JSON by document group, without some fields and ids, and read again with defaults."""
    folder = new_folder(s, "chunks")
    n = F.col("doc_id")
    rows = table(s, d, "documents").select(F.when(n % 11 > 0, F.concat(F.lit("c"), n.cast("string"))).alias("chunk_id"), F.when(n % 3 > 0, F.col("source")).alias("kind"), F.col("n_chars").alias("size"), (n % 5).alias("folder"))
    rows.write.partitionBy("folder").json(folder)
    back = s.read.schema("chunk_id string, kind string, size long").json(folder)
    return banks.with_defaults(back, "chunk_id", kind="text", tokens=0).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("tokens").cast("long").alias("tokens"))


def layer_newest(s, d):
    """Changes kept by source as layers; of each layer the newest hundred."""
    folder = new_folder(s, "layers")
    table(s, d, "client_changes").where("source IS NOT NULL").select("change_id", "valid_at", "op", F.col("source").alias("layer")).write.partitionBy("layer").parquet(folder)
    found = banks.newest(s.read.parquet(folder), "layer", [F.desc_nulls_last("valid_at"), F.asc("change_id"), F.asc_nulls_first("op")], 100)
    return found.select("layer", "change_id", "op", "place")


def product_updates(s, d):
    """Texts of items with new prices and brands line by line, and their properties with the newer ones over the older."""
    i = table(s, d, "items")
    text = F.concat(F.lit("name: "), F.coalesce("name", F.lit("?")), F.lit("\nsize: "), F.coalesce(F.col("size").cast("string"), F.lit("?")), F.lit("\nfree line"))
    new = {"size": F.when(F.col("item_id") % 2 == 0, F.col("item_id")), "brand": F.when(F.col("item_id") % 3 == 0, F.col("brand"))}
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("kind"), F.coalesce("kind", F.lit("?")))
    newer = F.when(F.col("item_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3")))
    props = banks.merged_maps(old, newer)
    return i.select("item_id", F.md5(banks.updated_lines(text, new)).alias("digest"), F.concat_ws(",", props["a"], props["kind"], props["b"]).alias("props"))


QUERIES = {f.__name__: f for f in (question_bank, question_bank_semantic, blocked_candidates, store_parts, store_manifest, store_export, store_similarity, chunks_saved, layer_newest, product_updates)}
_CODE = "'C' || (35 + (v.label + v.vec_id) % 5)"
_MATCHED = f"""em AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), bar(code, least) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in THRESHOLDS.items())}),
sc AS (SELECT q.vec_id AS query_id, {_CODE} AS code, v.vec_id AS id, round(coalesce(list_cosine_similarity(v.e, q.e), 0), 6) AS score FROM em v, em q WHERE q.vec_id % 20 = 0 AND v.vec_id % 20 <> 0),
mt AS (SELECT query_id, code, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, code ORDER BY score DESC, id) AS r FROM sc) JOIN bar USING (code) WHERE r = 1 AND score >= least)"""
_STORED = """pt AS (SELECT p AS part, concat_ws(' ', name, kind) AS text, brand AS source, min(item_id + p) AS vec_id FROM items, range(3) x(p) WHERE item_id % (p + 1) = 0 GROUP BY ALL HAVING min(item_id + p) IN (SELECT vec_id FROM embeddings)),
ls AS (SELECT text, part, vec_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY part DESC, vec_id DESC, source DESC NULLS LAST) AS r FROM pt) WHERE r = 1)"""
ORACLE = {
    "question_bank": """WITH b AS (SELECT 'C35' AS code, trim(' ' || name || ' ' || kind) AS question, brand AS risk, 'items' AS sheet FROM items UNION ALL SELECT 'C' || (36 + vendor_id % 3), trim(name), NULL, 'vendors' FROM vendors
UNION ALL SELECT NULL, trim(text), 'b', 'benchmark' FROM benchmark) SELECT sheet, code, count(*) AS n, count(DISTINCT question) AS questions, count(risk) AS risks FROM b WHERE length(question) >= 2 GROUP BY ALL""",
    "question_bank_semantic": f"WITH {_MATCHED} SELECT * FROM mt",
    "blocked_candidates": f"WITH {_MATCHED} SELECT code, count(*) AS blocked, count_if(code IN ('C35', 'C36', 'C38') AND score >= {SURE})::BIGINT AS candidates FROM mt GROUP BY code",
    "store_parts": f"WITH {_STORED} SELECT text, part::INTEGER AS part, vec_id, source FROM ls",
    "store_manifest": f"WITH {_STORED} SELECT part::INTEGER AS part, source, count(*) AS rows, true AS has_files FROM pt GROUP BY ALL",
    "store_export": f"WITH {_STORED} SELECT text, part::INTEGER AS part, vec_id, source FROM ls",
    "store_similarity": f"""WITH {_STORED}, sv AS (SELECT text, CAST(embedding AS DOUBLE[]) AS e FROM ls JOIN embeddings USING (vec_id)), i AS (SELECT item_id, concat_ws(' ', name, kind) AS one, concat_ws(' ', kind, name) AS swapped FROM items),
p AS (SELECT a.item_id, a.one, CASE WHEN a.item_id % 7 = 0 THEN a.swapped ELSE b.one END AS two FROM i a JOIN i b ON b.item_id = a.item_id + 1)
SELECT item_id, coalesce(round(list_cosine_similarity(x.e, y.e), 6), 0) AS score FROM p LEFT JOIN sv x ON x.text = one LEFT JOIN sv y ON y.text = two""",
    "chunks_saved": "SELECT coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, 'text') AS kind, count(*) AS n, sum(n_chars)::BIGINT AS size, 0::BIGINT AS tokens FROM documents WHERE doc_id % 11 > 0 GROUP BY 1",
    "layer_newest": "SELECT layer, change_id, op, r::INTEGER AS place FROM (SELECT source AS layer, change_id, op, row_number() OVER (PARTITION BY source ORDER BY valid_at DESC NULLS LAST, change_id, op NULLS FIRST) AS r FROM client_changes WHERE source IS NOT NULL) WHERE r <= 100",
    "product_updates": """SELECT item_id, md5('name: ' || coalesce(name, '?') || chr(10) || 'size: ' || CASE WHEN item_id % 2 = 0 THEN item_id::VARCHAR ELSE coalesce(size::VARCHAR, '?') END || chr(10) || 'free line'
|| CASE WHEN item_id % 3 = 0 AND brand IS NOT NULL THEN chr(10) || 'brand: ' || brand ELSE '' END) AS digest,
CASE WHEN item_id % 2 = 0 THEN '2,' || coalesce(kind, '?') || ',3' ELSE '1,' || coalesce(kind, '?') END AS props FROM items""",
}
