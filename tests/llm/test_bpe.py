import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import bpe

PATH, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    return bpe.Codec(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


TEXTS = ["", "Hello, world!", " \n\t  x", "aaaaaaaaaaaaaaaa", "abababababab" * 40, "<|endoftext|>", "naïve café übergrößen ñandú",
         "日本語のテキスト 🙂🙂", "it's we'll I'd", "0123456789" * 30, "x" * 5000, "é" * 3000, "é​﻿", "!!!???...%%%", "ab " * 9000]


def test_like_tiktoken(both):
    own, tik = both
    assert [ids(x) for x in own.encode_block(TEXTS)] == [tik.encode_ordinary(t) for t in TEXTS]
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choice("abcdehinorst  éñß,.\n0AB日🙂") for _ in range(rng.randrange(1, 400)))
        assert ids(own.encode(text)) == tik.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_any_ranks():
    """Rank tables where a longer token precedes its parts."""
    rng = random.Random(1)
    for _ in range(60):
        tokens = {bytes([b]): i for i, b in enumerate(range(256))}
        while len(tokens) < 256 + 25:
            tokens.setdefault(bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))), len(tokens))
        own = bpe.Codec(tokens, r"\w+|\W+")
        tik = tiktoken.Encoding("t", pat_str=r"\w+|\W+", mergeable_ranks=tokens, special_tokens={})
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(30)]
        assert [ids(x) for x in own.encode_block(texts)] == [tik.encode_ordinary(t) for t in texts]


def test_columns(spark, both):
    rows = [(1, "one two", "z"), (1, "one two", "z"), (2, None, None), (None, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = bpe.decode_documents(bpe.encode_documents(df, PATH, PATTERN), PATH, PATTERN, out="back").select("doc_id", "text", "decoded", "token_ids", "back").collect()
    assert sorted((r.doc_id or 0, r.text or "", bytes(r.back).decode()) for r in out) == [(0, "", ""), (1, "one two", "one two"), (1, "one two", "one two"), (2, "", "")]
    assert ids(bytes(next(r for r in out if r.doc_id == 1).token_ids)) == both[1].encode_ordinary("one two")
    assert bpe.encode_documents(df.where(F.lit(False)), PATH, PATTERN).collect() == []


def test_memory_of_new_words(monkeypatch, both):
    """A million distinct words in one block: neither the table nor a replay goes beyond its bound."""
    own, largest = bpe.Codec(both[0].ranks, PATTERN), [0, 0]
    learn = own._learn

    def learnt(words):
        largest[0] = max(largest[0], sum(len(w) + 16 for w in words))
        learn(words)
        largest[1] = max(largest[1], len(own.known))

    monkeypatch.setattr(own, "_learn", learnt)
    texts = (" ".join(f"q{i * 100 + k:x}z" for k in range(100)) for i in range(10_000))
    out = own.encode_block(texts)
    assert len(out) == 10_000 and largest[0] < bpe.UNSEEN_BYTES * 1.1 and largest[1] < bpe.KNOWN_WORDS + bpe.UNSEEN_BYTES // 16
    for i in (0, 4321, 9999):
        assert ids(out[i]) == both[1].encode_ordinary(" ".join(f"q{i * 100 + k:x}z" for k in range(100)))


def test_long_texts_in_parts(monkeypatch, both):
    for name in ("PART_WORDS", "HELD_WORDS", "UNSEEN_BYTES"):
        monkeypatch.setattr(bpe, name, 40)
    own = bpe.Codec(both[0].ranks, PATTERN)
    texts = [t * 3 for t in TEXTS]
    assert [ids(x) for x in own.encode_block(texts)] == [both[1].encode_ordinary(t) for t in texts]
    assert own.encode_block([]) == [] and own.encode_block([None]) == [b""]


def test_table_starts_anew(monkeypatch, both):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    own = bpe.Codec(both[0].ranks, PATTERN)
    for text in ["alpha beta gamma delta epsilon", "zeta eta theta iota"]:
        assert ids(own.encode_block([text])[0]) == both[1].encode_ordinary(text)
        assert ids(own.encode(text)) == both[1].encode_ordinary(text)
