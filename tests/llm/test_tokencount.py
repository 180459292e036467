import random

import pytest
import sentencepiece
from lodestone.llm import tokencount as tc


@pytest.fixture(scope="module")
def model():
    return tc.model_bytes(tc.default_model())


@pytest.fixture(scope="module")
def library(model):
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    return lambda text: len(own.encode(text or ""))


def texts(rng):
    words = ["the", "reading", "straße", "日本語", "😀", "\u2581", "\u0000", "  ", "\n", "\t", "<s>", "aaaa", "Ωmega", "é"]
    out = [None, "", " ", "a", " " * 999, "a" * 3000, "日本" * 900, "😀" * 700, "\u2581 " * 400, "<s></s>" * 200, "ab" * 1501]
    return out + ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(700))) for _ in range(60)]


def test_counts_by_chunks_are_the_library_s(spark, model, library):
    """Chunks of 200 code points and overlaps of 8: many splices fail at first, and the overlaps widen."""
    every = texts(random.Random(1))
    rows = [(i, t, 7, "k") for i, t in enumerate(every + every[:20])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, key string")
    found = tc.count_tokens(df, model, size=200, overlap=8)
    assert found.columns == ["doc_id", "text", "key", "n_tokens"]
    assert sorted((r.doc_id, r.n_tokens) for r in found.collect()) == [(i, library(t)) for i, t, *_ in rows]


def test_widens_where_chunks_have_no_symbol_in_common(spark, model, library):
    """Long runs of one letter are cut into other pieces by every chunk."""
    rng = random.Random(2)
    rows = [(str(i), rng.choice("abn=- ") * rng.randrange(900, 4000)) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, text string")
    held = spark.sparkContext.broadcast(model)
    first = {r.key: r.n_tokens for r in tc._spliced(df, held, 100, 1).collect()}
    assert any(n is None for n in first.values())
    assert all(n in (None, library(t)) for (k, t) in rows for n in [first[k]])
    assert {r.key: r.n_tokens for r in tc.huge_counts(df, held, 100, 1).collect()} == {k: library(t) for k, t in rows}


def test_symbols_add_up(model, library):
    for text in filter(None, texts(random.Random(3))):
        n, own = tc.symbols(model, text, 40)
        assert n == library(text) and own[0, 0] == 39 and own[-1, 1] == 40 + len(text) and own[-1, 3] == n


def test_splice_takes_only_symbols_of_both():
    import numpy as np

    left = np.array([(0, 3, 5, 1), (3, 6, 8, 2), (6, 9, 4, 3)])
    right = np.array([(2, 6, 9, 1), (6, 9, 4, 2), (9, 12, 8, 3)])
    assert tc.splice(left, right, 6) == (3, 2)
    assert tc.splice(left[:2], right, 6) is None and tc.splice(left[:0], right, 6) is None


def test_no_rows_and_small_texts_only(spark, model):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tc.count_tokens(df, model).collect() == []
