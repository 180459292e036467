"""Lexical search over ``documents``."""

from __future__ import annotations

from lodestone.operators import bm25
from lodestone.sources.shared import new_folder
from lodestone.sources.tables import table

SEARCHES = [(1, "the nation heention nation"), (2, "eau mentre licensed"), (3, "der heit token"), (4, "ción mente license")]


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def bm25_topk(spark, sf_dir):
    searches = spark.createDataFrame(SEARCHES, "query_id int, query string")
    return bm25.bm25_search(_docs(spark, sf_dir), searches)


_TERMS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: length(t) > 1)"
_POST = f"post AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL)"
_LEN = f"dl AS (SELECT doc_id AS id, len({_TERMS}) AS dl FROM documents)"
_SEARCH = ", ".join(f"({i}, '{q}')" for i, q in SEARCHES)

_ASKED = f"q AS (SELECT query_id, unnest(string_split(lower(query), ' ')) AS term FROM (VALUES {_SEARCH}) v(query_id, query))"


def bm25_saved_topk(spark, sf_dir):
    """The same from an index that is written and read again."""
    path = new_folder(spark, "bm25")
    bm25.save_index(_docs(spark, sf_dir), path)
    return bm25.search_index(spark, path, spark.createDataFrame(SEARCHES, "query_id int, query string"))


QUERIES = {
    "bm25_saved_topk": bm25_saved_topk,
    "bm25_topk": bm25_topk,
    "bm25_postings": lambda s, d: bm25.postings(_docs(s, d)),
    "bm25_doc_freq": lambda s, d: bm25.doc_freq(bm25.postings(_docs(s, d))),
    "bm25_corpus_stats": lambda s, d: bm25.corpus_stats(_docs(s, d)),
}
ORACLE = {
    "bm25_topk": f"""
WITH {_POST}, {_LEN}, st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
{_ASKED},
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT query_id, id, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5
  / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post JOIN q USING (term) JOIN df USING (term) JOIN dl USING (id) CROSS JOIN st GROUP BY ALL)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10""",
    "bm25_postings": f"WITH {_POST} SELECT * FROM post",
    "bm25_doc_freq": f"WITH {_POST} SELECT term, count(*) AS df FROM post GROUP BY term",
    "bm25_corpus_stats": f"WITH {_LEN} SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl",
}
ORACLE["bm25_saved_topk"] = ORACLE["bm25_topk"]
