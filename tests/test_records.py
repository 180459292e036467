"""Readers, rules, caches, names and batched calls on small hand-made cases."""

import io
import zipfile
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.operators import batches, caching, dedup, entities, moderation
from lodestone.sources import files, sinks


def test_json_leaves_out_malformed_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "t": "x"}\n{"id": \n{"id": 2, "t": null}\n')
    schema = spark.createDataFrame([], "id long, t string").schema
    assert sorted(map(tuple, files.json_rows(spark, str(tmp_path), schema).collect())) == [(1, "x"), (2, None)]


def test_csv_quotes_line_ends_and_routing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,description,tags\n"say ""a""","two\nlines","x , y"\n')
    products, entries = files.routed(files.csv_rows(spark, str(tmp_path)))
    assert entries is None and tuple(products.first()) == ('say "a"', "two\nlines", ["x", "y"])
    assert files.routed(spark.createDataFrame([(1,)], "other int")) == (None, None)


def test_markdown_sections(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\n**Tags:** a, b\n**tags:** c\n## 内容\nfirst\n\nsecond\n# Empty\n\n# Three\nplain\n")
    (tmp_path / "b.md").write_text("")
    found = {r.title: (r.content, r.meta) for r in files.markdown_sections(spark, str(tmp_path)).collect()}
    assert found == {"One": ("first\n\nsecond", {"tags": "c"}), "Three": ("plain", {})}


def test_word_list_and_documents(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" bad \n\n# note\nworse\n")
    assert [r.word for r in files.word_list(spark, str(tmp_path)).collect()] == ["bad", "worse"]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:p><w:t>a</w:t><w:t>b</w:t></w:p><w:p><w:t>c</w:t></w:p></w:document>')
    (tmp_path / "d.docx").write_bytes(raw.getvalue())
    (tmp_path / "e.docx").write_bytes(b"no zip")
    (tmp_path / "f.xyz").write_bytes(b"?")
    found = {r.path.rsplit("/", 1)[-1]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert found["d.docx"].text == "ab\nc" and found["d.docx"].error is None
    assert found["e.docx"].error and found["f.xyz"].error and found["w.txt"].text.startswith(" bad")


def test_replace_partitions_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, "k")
    sinks.replace_partitions(spark.createDataFrame([(3, "a")], "v int, k string"), path, "k")
    sinks.replace_partitions(spark.createDataFrame([], "v int, k string"), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(2, "b"), (3, "a")]


@pytest.mark.parametrize("text, lang", [
    ("你好", "zh"), ("สวัสดี", "th"), ("ひらがな", "ja"), ("안녕", "ko"), ("Bonjour à tous", "fr"), ("HELLO hola", "en"), ("", "en"), (None, None)])
def test_language(spark, text, lang):
    assert spark.createDataFrame([(text,)], "t string").select(rules.language_of(F.col("t"))).first()[0] == lang


def test_text_rules(spark):
    minus = F.struct(F.lit(-1).alias("k"))
    row = spark.createDataFrame([("a<think>x\ny</think> b <think>", 'so {"k": 1} and {"k"', "{no}", "to be to", "p_chunk_1_chunk_2")], "a string, b string, e string, c string, d string").select(
        rules.without_thoughts(F.col("a")), rules.json_object(F.col("b"), "k int", minus)["k"], rules.json_object(F.col("e"), "k int", minus)["k"],
        rules.rebuilt(rules.inverted(F.split("c", " "))), rules.base_id(F.col("d"))).first()
    assert tuple(row) == ("a b <think>", 1, -1, "to be to", "p_chunk_1")


def test_ttl_hits_across_stretches(spark):
    at = lambda h, m, s=0: datetime(2024, 1, 1, h, m, s)
    log = [(1, "a", at(0, 50)), (2, "a", at(1, 5)), (3, "a", at(1, 40)), (4, "b", at(1, 5)), (5, "a", None), (6, None, at(3, 0)), (7, None, at(3, 0)), (8, "a", at(2, 10, 1))]
    found = caching.ttl_hits(spark.createDataFrame(log, "id int, k string, ts timestamp_ntz"), ["k"], "ts", "id", 1800)
    assert {r.id: r.hit for r in found.collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False, 7: True, 8: False}


def test_near_names_against_brute_force(spark, monkeypatch):
    names = ["blue bolt", "Blue Bolt", "bolt blue", "red ring", "rde ring", "", None, "a"]
    asked = ["blue bolts", "red rings", "a", ""]
    table = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = sorted((r.query, r.id, r.ratio) for r in entities.near_names(table, asked).collect())
    want = [(q, i, round(SequenceMatcher(None, q, n.lower()).ratio(), 6)) for q in asked for i, n in enumerate(names) if n is not None]
    assert got == sorted(w for w in want if w[2] >= 0.8)
    spans = spark.createDataFrame([(1, "blue bolts and a red ring"), (2, "a a"), (3, None)], "doc_id int, text string")
    once = [sorted(map(tuple, f.collect())) for f in (entities.mentions(spans, [*asked, *asked, "red"]), entities.multi_match(table, asked))]
    monkeypatch.setattr(entities, "MAX_NAMES", 1)  # each name in a pass of its own
    assert sorted((r.query, r.id, r.ratio) for r in entities.near_names(table, asked).collect()) == got
    assert [sorted(map(tuple, f.collect())) for f in (entities.mentions(spans, [*asked, *asked, "red"]), entities.multi_match(table, asked))] == once


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "aaa b"), (2, None), (3, "")], "doc_id int, text string")
    assert sorted(map(tuple, entities.mentions(docs, ["aa", "b", ""]).collect())) == [(1, "aa", 1, 1), (1, "b", 1, 5)]
    assert entities.mentions(docs, []).count() == 0


def test_batched_calls_keep_errors_by_row(spark):
    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [t + "!" for t in texts]

    rows = spark.createDataFrame([("a",), ("bad",), (None,), ("c",)], "text string").coalesce(1)
    assert [tuple(r) for r in batches.call_batch(rows, "text", model).collect()] == [
        ("a", "a!", None), ("bad", None, "RuntimeError: no"), (None, None, None), ("c", "c!", None)]


@pytest.mark.parametrize("links", [[], [(1, 2)], [(1, 2), (2, 3), (3, 4), (4, 5)], [(1, 3), (2, 3), (3, 4), (1, 5), (5, 6), (2, 6), (1, 2)]])
def test_greedy_keep_follows_the_order(spark, links):
    kept = []
    for i in range(1, 8):
        if not any((k, i) in links for k in kept):
            kept.append(i)
    rows = spark.range(1, 8)
    pairs = spark.createDataFrame([*links, *links[:1]], "a long, b long")
    assert sorted(r.id for r in dedup.greedy_keep(rows, pairs, "id").collect()) == kept


def test_labelled_fields_end_at_later_labels(spark):
    texts = [("A：1 B：2\nC： 3 ",), ("C：x A：y B：",), ("none",), (None,), ("",)]
    got = spark.createDataFrame(texts, "t string").select(*rules.labelled(F.col("t"), ["A", "B", "C"])).collect()
    assert [tuple(r) for r in got] == [("1", "2", "3"), ("y", "", "x A：y B："), (None,) * 3, (None,) * 3, (None,) * 3]


def test_reply_scores(spark):
    texts = ['a {"scores": [10, 5]} b', "7 then 3.5 then 1 then 2", "none", "", '{"other": 1}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(rules.reply_scores(F.col("t"), 3)).collect()]
    assert got == [[1.0, 0.5, 0.5], [0.7, 0.35, 0.1], [5.0] * 3, [5.0] * 3, [0.5] * 3]


def test_bank_in_several_passes(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "two three"), (3, None)], "doc_id int, text string")
    bank = spark.createDataFrame([(1, "two"), (2, "three"), (3, ""), (4, None), (5, "one two")], "item_id int, text string")
    for block in (1, 2, 100):
        assert sorted(map(tuple, moderation.contained(docs, bank, block).collect())) == [(1, 1), (1, 5), (2, 1), (2, 2)]


def test_bank_by_characters(spark):
    """A bank is cut by its characters too, and a worker holds few texts at a time, not one of Arrow's batches."""
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, None), (4, "")], "doc_id long, text string")
    bank = spark.createDataFrame([(1, "beta"), (2, "gamma"), (3, "alpha"), (4, "a b"), (5, "delta")], "item_id long, text string")
    for chars in (1, 8, 1000):
        found = moderation.contained(docs, bank, chars=chars)
        assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 3), (1, 4), (2, 1), (2, 2)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "Arrow" not in plan


def test_multi_match(spark):
    names = spark.createDataFrame([(1, "Blue Bolt"), (2, "bolt"), (3, "red"), (4, None), (5, "")], "id int, name string")
    got = [(r.query, r.id, r.score, r["rank"]) for r in entities.multi_match(names, ["blue bolt", "bolts"], k=2).orderBy("query", "rank").collect()]
    assert got == [("blue bolt", 1, 2.4, 1), ("blue bolt", 2, 0.6, 2), ("bolts", 2, round(0.8 * round(8 / 9, 6) + 0.6, 6), 1)]


def test_unbounded_files_are_told(spark, tmp_path):
    """The check of bounded files fails where a single file holds more."""
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "few"))
    spark.range(500).coalesce(1).write.parquet(str(tmp_path / "many"))
    by_file = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path)).groupBy("_metadata.file_path").count()
    assert by_file.selectExpr("every(count <= 100)").first()[0] is False


def test_capitals_are_one_letter_each(spark, tmp_path):
    from lodestone.plans import records as plans

    rows = [(1, "straße ŉ ﬁn ᾳ é"), (2, "a\nb"), (3, "x" * 19 + "ßß")]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.item_id: (r.reply, r.error) for r in plans.model_batch(spark, str(tmp_path)).collect()}
    assert found == {1: ("STRAẞE ŉ ﬁN ᾼ É", None), 2: (None, "ValueError: line end"), 3: ("X" * 19 + "ẞ", None)}
