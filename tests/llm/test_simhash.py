import random

import numpy as np
import xxhash

from lodestone.llm import simhash
from lodestone.llm.components import components


def brute_fingerprint(text):
    words = [w for w in _split((text or ""))]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_components(rows):
    """rows: (id, text) → list of least ids, by testing all pairs."""
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k is None, k or 0, f"{fps[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(rows))


def result(df):
    return sorted((r.id is None, r.id or 0, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in df.collect())


def test_fingerprint_matches_definition():
    for text in [None, "", " \t\n", "One", "one TWO", "a b c d e a b c", "É é x y\x0bz   w", "x " * 70000]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows) * 7 % 191, " ".join(copy)))
    rows += [(None, None), (500, ""), (501, "  "), (None, rows[0][1]), rows[1], (7000, "long " * 30000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fp string")
    assert result(simhash.near_duplicates(df)) == brute_components(rows)


def test_links_connect_all_planted_distances(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for d in (1, 2, 3, 4):
            for bits in (rng.choice(64, d, replace=False), rng.choice(32, d, replace=False)):
                fps.add(b ^ sum(1 << int(x) for x in bits))
    arr = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in arr], "fp long")
    comp = {r.node & (2**64 - 1): r.root for r in components(simhash.links(df)).collect()}
    for i, a in enumerate(arr):
        for b in arr[:i]:
            if (a ^ b).bit_count() <= 3:
                assert comp[a] == comp[b]


def test_empty_table_and_keep_one(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []
    rows = [(4, "same words here now", "a"), (2, "same words here now", "b"), (2, "same words here now", "b"), (9, "other text", "c"), (None, "other text", "c"), (None, "alone", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.where("(doc_id = 2) or doc_id = 9 or text = 'alone'").distinct().collect()))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}
