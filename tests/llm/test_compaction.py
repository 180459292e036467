import random
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
from lodestone.llm import compaction, scan

import __spark_entry__ as entry


def greedy(files, target):
    """First file of each file's group, by one walk; files are (source, block, slot, live)."""
    out, open_ = {}, {}
    for source, block, slot, live in sorted(files):
        size, first = open_.get(source, (None, None))
        if size is None or size + live > target:
            size, first = 0, (source, block, slot)
        open_[source] = size + live, first
        out[source, block, slot] = first
    return out


def made(rng, n, sizes, sources=("", "a", "b")):
    names = {(rng.choice(sources), rng.randrange(n), rng.randrange(8)) for _ in range(n)}
    return [(*k, rng.choice(sizes)) for k in sorted(names)]


def test_steps_compose_like_a_walk():
    """Parts of any cut, folded in any order, leave the state that a walk over all files leaves."""
    rng = random.Random(1)
    for case in range(300):
        sizes = rng.choice([[0], [0, 1, 2], [1, 3, 5], [4, 6, 11], [0, 9, 10, 11, 25]])
        files = made(rng, rng.randrange(2, 40), sizes)
        want = greedy(files, 10)
        cuts = sorted(rng.sample(range(1, len(files)), min(len(files) - 1, rng.randrange(0, 8)))) if len(files) > 1 else []
        bounds = list(zip([0, *cuts], [*cuts, len(files)]))
        parts = []
        for number, (a, b) in enumerate(bounds):
            source, live = np.array([f[0] for f in files[a:b]], object), np.array([f[3] for f in files[a:b]], np.int64)
            parts.append(compaction.steps(source, live, number << 32, 10))
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [compaction.compose(parts[i], parts[i + 1], 10)]
        source, _, start = compaction.follow_up(None, parts[0], 10)
        part = bounds[start >> 32]
        assert files[part[0] + (start & 0xFFFFFFFF)][:3] == want[files[-1][:3]], case


def test_groups_over_parts_and_levels(spark, monkeypatch):
    """One long source without a break, many zero files, and files over the target, in parts of four and a tree of three levels."""
    monkeypatch.setattr(compaction, "PART", 4)
    monkeypatch.setattr(scan, "FAN", 3)
    rng = random.Random(2)
    for sizes in ([0], [0, 1, 2, 3], [40, 60, 101, 0]):
        files = made(rng, 120, sizes, ("", "long"))
        df = spark.createDataFrame(files, "source string, block long, slot long, live_bytes long").repartition(3)
        got = {(r.source, r.block, r.slot): (r.first_source, r.first_block, r.first_slot) for r in compaction.groups_of(df, 100).collect()}
        assert got == greedy(files, 100)


def test_queue_prefix_in_parts(spark, monkeypatch):
    monkeypatch.setattr(compaction, "PART", 5)
    monkeypatch.setattr(scan, "FAN", 2)
    rng = random.Random(3)
    groups = [(rng.choice("ab"), i, 0, rng.choice([1, 2, 3]), rng.choice([0, 5, 7])) for i in range(60)]
    df = spark.createDataFrame(groups, "source string, block long, slot long, n_files long, bytes long").repartition(4)
    got = sorted((r.queue_index, r.source, r.block) for r in compaction.queue_prefix(df).collect())
    total, up_to, want = sum(g[4] for g in groups), 0, []
    for i, g in enumerate(sorted(groups, key=lambda g: (-g[3], g[4], g[0], g[1], g[2]))):
        up_to += g[4]
        if 100 * up_to <= 50 * total:
            want.append((i, g[0], g[1]))
    assert got == want


def test_hash_streams_over_batches():
    lines = [(f"s{i // 7}", 0, 0, f"{i}:x\n".encode()) for i in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines[i : i + 3])], [*compaction._TO, "line"]) for i in range(0, 40, 3)]
    got = {r["to_source"]: r["live_sha256"] for b in compaction._hashed(iter(batches)) for r in b.to_pylist()}
    assert got == {f"s{k}": sha256(b"".join(x[3] for x in lines if x[0] == f"s{k}")).hexdigest() for k in range(6)}


def test_odd_rows_against_sql(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, negative ids, other columns that clash in name."""
    rng = random.Random(4)
    rows = [(i * 37, rng.choice(["a", "b", None, ""]), rng.choice([None, "", "é" * rng.randrange(2000), "x" * rng.randrange(9000)]), "extra", 1) for i in range(700)]
    rows += [(None, "a", "no id", "extra", 2)] * 2 + [(-5, "a", "below", None, 3)] + rows[:20] + [(74, "a", "y" * 40000, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, slot string, bytes int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["op11_compaction_plan"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(compaction.ORACLE_SQL["op11_compaction_plan"])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=key) == sorted((tuple(dict(zip(want.columns, r))[c] for c in order) for r in want.fetchall()), key=key)


def test_sql_checksum():
    from lodestone.llm.crcsql import TABLE, crc32_sql

    con = duckdb.connect()
    for text in ["", "0", "123456", "7:éÿ×abc"]:
        found = con.execute(f"WITH {TABLE} SELECT {crc32_sql('x')} FROM (SELECT ? AS x), crc_table", [text]).fetchone()[0]
        assert found == zlib.crc32(text.encode())


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert compaction.compact(compaction.dealt_rows(docs)).collect() == []
