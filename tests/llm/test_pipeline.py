"""The pipeline against its operators run by themselves on a small table."""

import hashlib

import corpus_pipeline as cp
from lodestone.llm import bpe, decontam, pii, quality
from pyspark.sql import functions as F

from test_copies import brute as brute_copies

SF = "/root/testdata/sf0.001"


def test_run_against_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    model = quality.fit_tables(spark, SF)
    kept = {k for k, r in rows.items() if round(float(model.score(quality.features(r["text"])[None])[0]), 6) >= 0.3}
    kept = set(brute_copies([(k, rows[k]["text"]) for k in sorted(kept)]))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    index = decontam.Index([(r.item_id, r.text) for r in items])
    kept = {k for k in kept if not index.search(rows[k]["text"])}
    out = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert set(out) == kept and 0 < len(kept) < len(rows)
    codec = bpe.Codec(bpe.load_ranks(bpe.default_vocabulary()[0]), bpe.default_vocabulary()[1])
    for k, r in out.items():
        if not any(c in rows[k]["text"] for c in "0123456789@"):
            assert r.text == rows[k]["text"]
        assert bytes(r.token_ids) == codec.encode(r.text) and r.round_trip and r.n_tokens == len(r.token_ids) // 4
        assert r.n_chars == len(r.text)
        assert hashlib.sha256(codec.decode(bytes(r.token_ids))).digest() == hashlib.sha256(r.text.encode()).digest()


def test_stages_keep_columns_and_bear_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (5001, "", "en", "s", 0), (5001, "", "en", "s", 0), (5002, "a " * 30000, None, "s", 9)], docs.schema)
    table = docs.union(odd).withColumn("fp", F.lit("extra")).withColumn("id", F.lit(1))
    for name, stage in cp.STAGES[:-1]:
        done = stage(spark, table, SF)
        assert done.columns == table.columns, name
        assert 0 < done.count() <= table.count()
        assert stage(spark, table.limit(0), SF).count() == 0
        clashing = ["quality_score", "pii_counts", "__hash", "__kept_id", "__kept_hash", "__found", "__key", "__new", "__redrawn", "low", "with space"]
        more = table
        for c in clashing:
            more = more.withColumn(c, F.concat_ws(" ", F.lit(c), "doc_id"))
        done = stage(spark, more, SF)
        assert done.columns == more.columns, name
        for r in done.collect():
            assert all(r[c] == (c if r.doc_id is None else f"{c} {r.doc_id}") for c in clashing), name
    more = table.withColumn("__ids", F.lit("a")).withColumn("__back", F.lit("b")).withColumn("decoded", F.lit("c")).withColumn("round_trip", F.lit("d"))
    last = cp.STAGES[-1][1](spark, more, SF)
    assert last.columns == [*[c for c in more.columns if c != "round_trip"], "token_ids", "n_tokens", "round_trip"]
    assert {(r["__ids"], r["__back"], r.decoded, r.fp) for r in last.collect()} == {("a", "b", "c", "extra")}
    assert last.count() == table.count() and last.where("NOT round_trip").count() == 0
    assert pii.DEMO_KEY
