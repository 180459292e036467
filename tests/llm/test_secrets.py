import hashlib
import random
import re
import time
from collections import Counter
from math import log2

from lodestone.llm import secrets as sc

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def entropy(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/=_-]{20,}", text):
        if re.search(sc.ALLOW, m[0]):
            continue
        spans = []
        for at in range(len(m[0]) - 19):
            window = m[0][at : at + 20]
            h = -sum(c / 20 * log2(c / 20) for c in Counter(window).values())
            digits = sum(c.isdigit() for c in window)
            if re.fullmatch("[0-9A-Fa-f]+", window):
                kind, least = 3, 3.0
            elif not re.search("[A-Z]", window) or not re.search("[a-z]", window):
                kind, least = 4, 3.7 if digits >= 2 else 9.0
            else:
                kind, least = 5, 3.75 if digits else 4.0
            if h >= least - 1e-7:
                if spans and spans[-1][1] >= at and spans[-1][2] == kind:
                    spans[-1][1] = at + 20
                else:
                    spans.append([at, at + 20, kind])
        out += [(m.start() + a, k, m.start() + b) for a, b, k in spans]
    return out


def joined(spans):
    return ",".join(f"{sc.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_against_brute_force(spark):
    rng = random.Random(3)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    b64 = lambda n: "".join(rng.choice("ABCdefGHIjkl0123456789+/MNOpqrSTUv") for _ in range(n))
    texts = [None, "", "plain words only", 'token = "' + hexes(40) + '" é', "é🙂token=secret=" + b64(30), "token = token = " + b64(12),
             "AKIA" + "A" * 13 + " AKIAAKIA" + "B1" * 8, hexes(16), "a" * 400, "x" * 25 + b64(60) + "y" * 30, "Api_Key:'" + b64(11) + " PASSWORD : " + b64(12),
             "0f8fad5b-d9cd-469f-a165-70867728950e", "EXAMPLE" + b64(40), "word " * 30000 + b64(40), "A1b2" * 10, b64(3000), "ſecret=" + b64(20), "toKen=" + b64(20)]
    for _ in range(60):
        texts.append(rng.choice(["", "ñ ", "== "]).join(rng.choice([hexes(rng.randrange(10, 50)), b64(rng.randrange(10, 60)), "word ", "é", "secret: ", "AKIA", "-"]) for _ in range(8)))
    rows = [(i, t, "spans") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[4], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    df.createOrReplaceTempView("secret_docs")
    got = sc.scan(df).select("text", sc._joined(sc.F.col("secret_base")).alias("b"), sc._joined(sc.F.col("secret_spans")).alias("a")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        assert r.b == joined(base(text)), text[:200]
        assert r.a == joined(base(text) + entropy(text)), text[:200]
    assert sc.scan(df.limit(0)).collect() == []
    assert hashlib.sha256(b"").hexdigest()


def test_long_candidates_and_many_matches(spark):
    """A candidate of 100,000 characters and a text of 20,000 matches cost their length, not its square."""
    rng = random.Random(8)
    long = "".join(rng.choice("ABCdefGHIjkl0123456789+/MNOpqrSTUv") for _ in range(100_000))
    many = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(16)) for _ in range(20_000))
    df = spark.createDataFrame([(1, "warm up " + long[:50]), (2, long), (3, many)], "doc_id long, text string").repartition(3)
    began = time.time()
    out = {r.doc_id: r for r in sc.scan(df).select("doc_id", sc._joined(sc.F.col("secret_spans")).alias("a")).collect()}
    assert time.time() - began < 60
    assert out[2].a == joined(base(long) + entropy(long)) and out[3].a == joined(base(many) + entropy(many))


def test_random_secrets_are_found():
    """Share of random tokens with a flagged window, by alphabet; words and identifiers stay."""
    rng = random.Random(9)
    alphabets = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
                 "base62": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
    for name, letters in alphabets.items():
        for head in ("", "id-", "KEY="):
            found = sum(bool(entropy(head + "".join(rng.choice(letters) for _ in range(32)))) for _ in range(400))
            assert found >= 360, (name, head, found)
    plain = ["internationalization_configuration", "this-is-a-long-slug-about-the-weather", "getElementsByClassNameAndAttribute", "a" * 40, "ABSTRACT_BASE_CLASS_NAME_OF_THE_THING", "page_title_2024-section-header-text", "release-notes-2024-03-15-version-two",
             "IMG_20240315_123456_HDR_final_copy", "windows-server-2019-datacenter-x64"]
    assert not [t for t in plain if entropy(t)]
