import random
import re
import time
from collections import Counter

import numpy as np

from lodestone.llm import decontam as dc


def brute(rows, items):
    """Best window of each (row, item) by testing all windows of the item's length, or the whole of a shorter text."""
    out = set()
    for doc_id, text in rows:
        own = dc.words(text)
        for item_id, item in items:
            want = dc.words(item)
            if not want or not own:
                continue
            target = Counter(shingles(want))
            scores = [(round(similarity(Counter(shingles(own[s : s + len(want)])), target), 6), -s) for s in range(max(1, len(own) - len(want) + 1))]
            if max(scores)[0] >= 0.8:
                out.add((doc_id, item_id, max(scores)[0], -max(scores)[1]))
    return out


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def shingles(found):
    return [tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))]


def test_against_all_windows(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)] + ["Über", "ñu"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 12, 40])))) for k in range(25)]
    items += [(90, items[3][1]), (91, ""), (92, None), (93, "a a a a a a a a a a")]
    rows = []
    for k in range(80):
        body = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        own = dc.words(rng.choice(items[:25])[1])
        edit = rng.random()
        if edit < 0.3 and len(own) > 10:
            own[rng.choice([0, len(own) - 1, len(own) // 2])] = "changed"
        elif edit < 0.5 and len(own) > 10:
            own.insert(len(own) - 1, "added")
        at = rng.randrange(len(body) + 1)
        rows.append((k, " ".join(body[:at] + own + body[at:]).upper() if k % 7 == 0 else ", ".join(body[:at] + own + body[at:])))
    rows += [(100, None), (101, ""), (102, "a " * 40), (None, items[5][1]), rows[0], (103, "x y " * 40000 + (items[10][1]))]
    docs = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "doc_id long, text string, similarity double")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.id, r.item_id, r.similarity, r.first_word) for r in dc.matches(docs, table).collect()]
    short = [(a, b) for a, b in rows if a != 103]
    want = brute(short, [i for i in items if i[1]])
    assert {g for g in got if g[0] != 103} <= want and len(want) > 60
    assert len(want - set(got)) <= 0.02 * len(want)
    assert (103, 10) in {g[:2] for g in got}
    assert len(got) >= len(set(got))
    kept = dc.clean(docs, table)
    assert kept.columns == docs.columns
    dirty = {g[0] for g in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(a) for a, _ in rows if a not in dirty)


def test_passes_and_empty(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS_PER_PASS", 1)
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five"), (2, "two three four five six"), (3, "z")], "item_id long, text string")
    assert {(r.id, r.item_id) for r in dc.matches(docs, items).collect()} == {(1, 1), (1, 2)}
    assert [r.doc_id for r in dc.clean(docs, items).collect()] == [2]
    assert dc.matches(docs.limit(0), items).collect() == [] and dc.matches(docs, items.limit(0)).collect() == []


def test_blocks_find_all_within_radius():
    rng = random.Random(4)
    index = dc.Index([(i, " ".join(f"a{rng.randrange(300)}" for _ in range(12))) for i in range(200)])
    (length,) = index.lengths
    for at in range(0, 200, 9):
        for d in range(dc.RADIUS + 1):
            probe = int(length.prints[at])
            for bit in rng.sample(range(64), d):
                probe ^= 1 << bit
            assert at in length.near(np.array([probe], np.uint64))[1]


def test_blocks_leave_few_fingerprints_to_compare(monkeypatch):
    """Of random fingerprints at most a seventh is compared with the items of a length."""
    rng = random.Random(6)
    (length,) = dc.Index([(i, " ".join(f"a{rng.randrange(300)}" for _ in range(30))) for i in range(5)]).lengths
    prints = np.array([rng.getrandbits(64) for _ in range(20_000)], np.uint64)
    compared = []
    count = np.bitwise_count
    monkeypatch.setattr(dc.np, "bitwise_count", lambda x: compared.append(np.size(x)) or count(x))
    which, item = length.near(prints)
    monkeypatch.undo()
    want = {(a, b) for b, p in enumerate(length.prints) for a in np.flatnonzero(np.bitwise_count(prints ^ p) <= dc.RADIUS).tolist()}
    assert set(zip(which.tolist(), item.tolist())) == want and want
    assert sum(compared) < len(prints) * len(length.prints) / 7


def test_words_are_runs_of_letters_and_digits():
    """Of every character alike, whether the text is Latin-1 or not."""
    every = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for text in ["".join(f"a{c}b {c}" for c in every[:256]), "".join(f"a{c}b {c}" for c in every), "A_b\xa0C\x85d\x1cE-f²ªß", "İx Σας \ud800y", "", "_"]:
        assert dc.words(text) == re.findall(r"[^\W_]+", text.lower())
    assert dc.words(None) == []


def test_windows_of_any_size_have_their_fingerprints():
    """Running sums give each window's own SimHash, also where a lane is just full and for windows of unlike sizes."""
    rng = np.random.default_rng(7)
    hashes = np.concatenate([rng.integers(0, 1 << 64, 900, np.uint64), np.full(900, (1 << 64) - 1, np.uint64), np.zeros(300, np.uint64), rng.integers(0, 1 << 64, 66_000, np.uint64)])
    for n in (1, 2, 11, 127, 128, 254, 255, 256, 257, 900, 65_535, 65_536, 66_000):
        sums = dc.Sums(hashes, dc.Sums.width_for(n))
        first = np.arange(0, len(hashes) - n + 1, max(1, n // 3))
        some = first[:: max(1, len(first) // 300)]
        want = [dc.fingerprint(hashes[a : a + n]) for a in some]
        assert sums.prints(some, some + n, n).tolist() == [int(w) for w in want]
        sizes = np.arange(len(some)) % n + 1
        assert sums.prints(some, some + sizes, sizes).tolist() == [int(dc.fingerprint(hashes[a : a + m])) for a, m in zip(some, sizes)]
    assert dc.fingerprint(hashes[900:1800]) == (1 << 64) - 1


def test_neighbouring_lengths_share_a_table(monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(8 + k % 40))) for k in range(120)]
    texts = [" ".join(f"x{rng.randrange(3000)}" for _ in range(30)) + f" {items[k][1]} end" for k in range(0, 120, 3)] + ["", None, "x"]
    whole = list(dc.Index(items).search_all(texts))
    monkeypatch.setattr(dc, "TABLES", 7)
    shared = dc.Index(items)
    assert len({id(length.table) for length in shared.lengths}) <= 7
    assert list(shared.search_all(texts)) == whole and {(f[0], f[1]) for f in whole} >= {(k // 3, k) for k in range(0, 120, 3)}


def test_document_shorter_than_the_item():
    item = [f"a{i}" for i in range(50)]
    index = dc.Index([(1, " ".join(item))])
    for n in range(38, 51):
        want = similarity(Counter(shingles(item[:n])), Counter(shingles(item)))
        assert [(f[0], f[1]) for f in index.search(" ".join(item[:n]))] == ([(1, round(want, 6))] if want >= 0.8 else [])


def passage(rng, own, least):
    """A copy of the words with as many changes as the similarity allows."""
    for _ in range(200):
        tried = list(own)
        at = rng.randrange(len(tried))
        if rng.random() < 0.5:
            tried[at] = f"e{rng.randrange(10**6)}"
        elif rng.random() < 0.5:
            tried.insert(at, f"e{rng.randrange(10**6)}")
        else:
            del tried[at]
        if len(tried) >= 5 and similarity(Counter(shingles(tried)), Counter(shingles(own))) >= least:
            return passage(rng, tried, least) if rng.random() < 0.5 and least > 0.85 else tried
    return own


def test_recall_against_all_windows():
    """Of the windows that pass at least 0.95 are found, down to a similarity of 0.8; no other."""
    rng = random.Random(11)
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 12, 20, 35, 60, 110, 400])))) for k in range(60)]
    rows = []
    for k in range(250):
        body = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 120))]
        at = rng.randrange(len(body))
        rows.append((k, " ".join(body[:at] + passage(rng, dc.words(rng.choice(items)[1]), rng.choice([0.8, 0.8, 0.9])) + body[at:])))
    want = brute(rows, items)
    got = {(rows[place][0], *found[:3]) for place, *found in dc.Index(items).search_all([t for _, t in rows])}
    assert len(want) > 200 and got <= want and len(got) >= 0.95 * len(want)


def test_items_of_many_shingles_and_long_texts(monkeypatch):
    """The same rule holds for items above any size, and for texts that are searched in parts."""
    rng = random.Random(5)
    for n in (120, 140, 4097, 5000):
        own = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        index = dc.Index([(1, " ".join(own))])
        text = [f"x{i}" for i in range(50)] + [f"e{i}" for i in range(n // 50)] + own[n // 50 :] + [f"y{i}" for i in range(500)]
        ((item, score, first, _, _),) = index.search(" ".join(text))
        best = max((round(similarity(Counter(shingles(text[s : s + n])), Counter(shingles(own))), 6), -s) for s in range(45, 56))
        assert (item, score, first) == (1, best[0], -best[1])
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(30))) for k in range(20)]
    text = " ".join(" ".join(f"z{rng.randrange(3000)}" for _ in range(rng.randrange(300))) + " " + items[k][1] for k in range(20))
    whole = dc.Index(items).search(text)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 100)
    monkeypatch.setattr(dc, "LONG", 50)
    assert dc.Index(items).search(text) == whole and len(whole) == 20


def test_many_hits_of_a_common_beginning():
    """Items with one beginning, repeated in a text, cost no more than their windows."""
    head = " ".join(f"h{i}" for i in range(12))
    index = dc.Index([(i, f"{head} " + " ".join(f"t{i}x{k}" for k in range(12))) for i in range(300)])
    began = time.time()
    assert index.search(" ".join([head] * 400)) == []
    assert time.time() - began < 20
