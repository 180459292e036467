import random
from itertools import combinations

import corpus_pipeline as cp
import numpy as np
from lodestone.llm import copies


def brute(rows, similarity=0.8, size=5):
    """Least id of each group by testing all pairs; rows of (id, text) with distinct ids."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))})
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, y in combinations(range(len(rows)), 2):
        if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= similarity:
            group[find(x)] = find(y)
    least = {}
    for x, (k, _) in enumerate(rows):
        least[find(x)] = min(k, least.get(find(x), k))
    return sorted(least.values())


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_stage_drops_copies_beyond_three_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id IN (1, 2, 56, 255, 3)")
    kept = sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").select("doc_id").collect())
    assert kept == [1, 2, 3]


def test_recall_of_pairs_at_the_threshold():
    """Pairs of 0.8 to 0.9, as they would meet: nearly all do, also where texts are short."""
    rng, met, pairs = random.Random(3), 0, 0
    for n in (8, 9, 12, 16, 40, 100, 300, 900):
        for _ in range(60):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            a, best, other = copies.shingle_set(" ".join(words)), None, words
            for _ in range(60):
                tried = edited(rng, other, 1) if rng.random() < 0.7 else [*other, f"x{rng.randrange(10**6)}"]
                b = copies.shingle_set(" ".join(tried))
                shared = len(np.intersect1d(a, b))
                if 0.8 <= shared / (len(a) + len(b) - shared) < 1:
                    other, best = tried, b
            if best is not None:
                pairs += 1
                met += bool(copies.may_be_near(copies.prints(a)[None, :], copies.prints(best)[None, :])[0] or len(np.intersect1d(copies.without_two(a), copies.without_two(best))))
    assert pairs > 350 and met >= 0.95 * pairs


def test_small_sets_always_meet():
    """A text and the same without one or two words at either end: every pair at 0.8 has a common hash."""
    rng = random.Random(11)
    for n in range(6, 18):
        for _ in range(200):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            for other in (words[:-1], words[:-2], words[1:-1], words[2:], [*words, "x"]):
                a, b = (copies.shingle_set(" ".join(w)) for w in (words, other))
                shared = len(np.intersect1d(a, b))
                if max(len(a), len(b)) <= copies.FEW and shared / (len(a) + len(b) - shared) >= 0.8:
                    assert len(np.intersect1d(copies.without_two(a), copies.without_two(b)))


def test_against_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    line = "this line is in very many of the texts here".split()
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 8, 20, 60, 150]))] + line * rng.randrange(2)
        rows += [" ".join(edited(rng, base, rng.randrange(4))) for _ in range(rng.choice([1, 2, 5]))]
    crowd = [f"c{i}" for i in range(120)]
    rows += [" ".join(edited(rng, crowd, rng.choice([0, 1, 2, 3]))) for _ in range(150)]
    for n in (12, 13, 14, 15):  # without the last two words, in a cluster with others
        shared = [f"s{i}" for i in range(n)]
        rows += [" ".join(shared), " ".join(shared[:-2]), " ".join([*shared, "more"])]
        rows += [" ".join(words), " ".join(words[:-2])] if (words := [f"l{n}-{i}" for i in range(n)]) else []
    rows += [None, "", "  ", "one", "ONE", rows[0].upper()]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    for most in (5000, 3):  # clusters in one task, and dealt anew
        monkeypatch.setattr(copies, "CLUSTER_SETS", most)
        assert sorted(r.doc_id for r in copies.keep_one(table(spark, rows)).collect()) == brute(rows)
    assert sorted(r.doc_id for r in copies.keep_one(table(spark, rows), size=3, similarity=0.85).collect()) == brute(rows, 0.85, 3)


def test_smallest_sets_meet_only_equals(spark, monkeypatch):
    """Texts of one or two shingles: at 0.8 only equal sets are similar, so others have no hash in common and make no cluster."""
    texts = [" ".join(f"w{i}-{k}" for k in range(n)) for i, n in enumerate([1, 3, 5, 6, 6, 7, 8] * 6)]
    found = [copies.without_two(copies.shingle_set(t)) for t in texts]
    assert all(not len(np.intersect1d(a, b)) for a, b in combinations(found, 2))
    five, less = copies.shingle_set("a b c d e f g h i"), copies.shingle_set("a b c d e f g h")
    assert len(five) == 5 and len(np.intersect1d(copies.without_two(five), copies.without_two(less)))
    called = []
    monkeypatch.setattr(copies, "_within", lambda *_: called.append(1))
    rows = list(enumerate([*texts, texts[3].upper()]))
    assert sorted(r.doc_id for r in copies.keep_one(table(spark, rows)).collect()) == list(range(len(texts))) and not called


def test_pairs_of_a_cluster_are_listed_in_parts(monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    sets = [copies.shingle_set(" ".join(edited(rng, words, rng.choice([0, 1, 9])))) for _ in range(40)]
    sets = [np.array(s, np.uint64) for s in sorted({tuple(s.tolist()) for s in sets})]
    own = np.arange(len(sets)), np.arange(len(sets)), np.stack([copies.prints(s) for s in sets]), sets
    want = copies._connect(*own, 0.8)
    monkeypatch.setattr(copies, "LISTED", 3)
    assert copies._connect(*own, 0.8) == want and len(want) > 3
