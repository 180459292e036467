"""Plan of small-file compaction: which files are rewritten together, in which wave, and the hash of each result.

Per source the dirty or small files, in order, join a group as long as its live bytes allow. The
order is dealt into parts by ranges. Where two neighbours alone exceed the target, or the source
changes, a group must begin: the files between two such breaks are packed independently of all
others. Only a part's files before its first break depend on the group that is open before it;
what they make of each possible open group is a step function with few steps, and these functions
are composed along a tree (:mod:`lodestone.llm.scan`), so that a segment of any length, a whole
source without a break included, is packed in parallel.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import scan
from lodestone.llm.crcsql import TABLE, crc32_sql
from lodestone.sources.shared import settled

TARGET = 32_768
#: Bytes that opening a file costs, groups of a wave, and the per cent of the queue's bytes that are rewritten.
OPEN_COST, WAVE, SHARE = 4096, 16, 50
#: Files, or groups, of one part.
PART = 5000
FILE = ["source", "block", "slot"]


@dataclass
class Steps:
    """What a part makes of the group that is open before it.

    A file begins a group if the open bytes and ``sums``, those of the files up to it, exceed the
    target; the first such is followed by the open group (bytes, first file) in ``after``. Without
    such, ``none`` follows; its first file is None if the group that was open goes on, and the
    bytes are then those that it gains. ``fresh`` follows an open group of another source.
    """

    first: str
    last: str
    sums: np.ndarray
    after: list[tuple[int, int]]
    none: tuple[int, int | None]
    fresh: tuple[int, int]


def next_starts(source: np.ndarray, live: np.ndarray, target: int) -> np.ndarray:
    """For each file, where the next group begins if one begins here.

    Segments lie between forced breaks: a new source, or two neighbours beyond the target.
    """
    n = len(live)
    sums = np.cumsum(live)
    forced = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (live[1:] + live[:-1] > target)])
    ends = np.r_[forced[1:], n]
    end = np.repeat(ends, np.diff(np.r_[forced, n]))
    full = np.searchsorted(sums, sums - live + target, side="right")
    return np.minimum(np.maximum(full, np.arange(n) + 1), end)


def steps(source: np.ndarray, live: np.ndarray, at: int, target: int) -> Steps:
    """The steps of a part's files, which are numbered from ``at`` on."""
    n = len(live)
    follow = next_starts(source, live, target)
    last = np.arange(n)  # the last group's start, if one starts here
    for i in range(n - 1, -1, -1):
        if follow[i] < n:
            last[i] = last[follow[i]]
    sums = np.cumsum(live)
    run = int(np.argmax(source != source[0])) or n if (source != source[0]).any() else n

    def after(i: int) -> tuple[int, int]:
        j = last[i]
        return int(sums[-1] - sums[j] + live[j]), at + int(j)

    wide = np.flatnonzero(np.diff(sums[:run], prepend=0) > 0)
    wide = wide[: int(np.searchsorted(sums[wide], target, side="right")) + 1]  # beyond it no first start lies
    none = after(run) if run < n else (int(sums[run - 1]), None)
    return Steps(source[0], source[-1], sums[wide], [after(int(i)) for i in wide], none, after(0))


def follow_up(state: tuple | None, part: Steps, target: int) -> tuple[str, int, int]:
    """(source, bytes, first file) of the open group after a part."""
    if state is None or state[0] != part.first:
        return (part.last, *part.fresh)
    _, size, start = state
    if size > target:
        return (part.last, *part.fresh)
    i = int(np.searchsorted(part.sums, target - size, side="right"))
    if i < len(part.sums):
        return (part.last, *part.after[i])
    return (part.last, part.none[0] + size, start) if part.none[1] is None else (part.last, *part.none)


def compose(one: Steps, two: Steps, target: int) -> Steps:
    """The steps of two neighbouring parts as one."""

    def through(state: tuple[int, int]) -> tuple[int, int]:
        return follow_up((one.last, *state), two, target)[1:]

    sums, after = one.sums, [through(a) for a in one.after]
    if one.none[1] is not None:
        none = through(one.none)
    elif one.last != two.first:
        none = two.fresh
    else:
        sums, after = np.concatenate([sums, two.sums + one.none[0]]), after + two.after
        none = (one.none[0] + two.none[0], None) if two.none[1] is None else two.none
    return Steps(one.first, two.last, sums, after, none, through(one.fresh))


def _columns(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = table.sort_by([(c, "ascending") for c in FILE])
    return table, np.array(table["source"].to_pylist(), object), table["live_bytes"].to_numpy()


def _digest(target: int):
    def run(table: pa.Table) -> pa.Table:
        table, source, live = _columns(table)
        part = table["part"][0].as_py()
        own = steps(source, live, part << 32, target)
        return pa.table({"part": pa.array([part], pa.int64()), "digest": pa.array([pickle.dumps(own)], pa.binary())})

    return run


def _pack(target: int):
    """A part's files, with the number of the first file of the group that each belongs to, and their own."""

    def run(table: pa.Table) -> pa.Table:
        table, source, live = _columns(table)
        before, at = table["before"][0].as_py(), table["part"][0].as_py() << 32
        state = None if before is None else pickle.loads(before)
        first, n = 0, len(live)
        if state is not None and state[0] == source[0] and state[1] <= target:
            while first < n and source[first] == source[0] and state[1] + int(live[: first + 1].sum()) <= target:
                first += 1
        follow = next_starts(source, live, target)
        group = np.full(n, state[2] if first else -1, np.int64)
        while first < n:
            group[first : follow[first]] = at + first
            first = int(follow[first])
        out = {c: table[c] for c in FILE}
        return pa.table(out | {"number": pa.array(at + np.arange(n)), "first_number": pa.array(group)})

    return run


def _parts(df: DataFrame, *order) -> DataFrame:
    """``df`` in parts of about :data:`PART` rows by ranges of ``order``, with their number in ``part``."""
    count = max(1, -(-df.count() // PART))
    return settled(df.repartitionByRange(count, *order).withColumn("part", F.spark_partition_id().cast("long")))


def groups_of(files: DataFrame, target: int = TARGET) -> DataFrame:
    """(source, block, slot, first_source, first_block, first_slot) of each file: the first file of its group.

    ``files`` are (source, block, slot, live_bytes), each file once and without nulls. In order of
    block and slot a file joins its source's last group, or begins one if that would exceed
    ``target`` live bytes.
    """
    parts = _parts(files.select(*FILE, F.col("live_bytes").cast("long").alias("live_bytes")), *FILE)
    digests = parts.groupBy("part").applyInArrow(_digest(target), "part long, digest binary")
    before = scan.states_before(digests, lambda a, b: compose(a, b, target), lambda s, d: follow_up(s, d, target))
    packed = parts.join(before, "part").groupBy("part").applyInArrow(_pack(target), "source string, block long, slot long, number long, first_number long")
    packed = settled(packed)
    first = packed.where("number = first_number").select("first_number", *[F.col(c).alias(f"first_{c}") for c in FILE])
    return packed.join(first, "first_number").select(*FILE, *[f"first_{c}" for c in FILE])


def queue_prefix(queue: DataFrame, share: int = SHARE) -> DataFrame:
    """(source, block, slot, queue_index) of the longest prefix with ``share`` per cent of the bytes of ``queue``.

    ``queue`` has (source, block, slot, n_files, bytes); most files come first, then fewest bytes,
    then the smallest source, block and slot.
    """
    order = [F.desc("n_files"), F.asc("bytes"), *map(F.asc, FILE)]
    parts = _parts(queue.select(*FILE, "n_files", "bytes"), *order)
    total = parts.agg(F.sum("bytes")).first()[0] or 0
    sums = parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
    digests = sums.select("part", _pickled("rows", "bytes").alias("digest"))
    before = scan.states_before(digests, _add, _add_to).select("part", _unpickled("before").alias("b"))
    up_to = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.select("*", F.count(F.lit(1)).over(up_to).alias("row"), F.sum("bytes").over(up_to).alias("sum")).join(before, "part")
    placed = placed.select(*FILE, (F.col("row") - 1 + F.col("b.rows")).alias("queue_index"), (F.col("sum") + F.col("b.bytes")).alias("sum"))
    return placed.where(F.col("sum") * 100 <= F.lit(total * share)).select(*FILE, "queue_index")


def _add(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def _add_to(state: tuple | None, digest: tuple) -> tuple:
    return digest if state is None else _add(state, digest)


@F.arrow_udf(T.BinaryType())
def _pickled(rows: pa.Array, size: pa.Array) -> pa.Array:
    return pa.array([pickle.dumps(x) for x in zip(rows.to_pylist(), size.to_pylist())], pa.binary())


@F.arrow_udf(T.StructType([T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType())]))
def _unpickled(states: pa.Array) -> pa.Array:
    found = [(0, 0) if s is None else pickle.loads(s) for s in states.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["rows", "bytes"])


def plan(files: DataFrame, target: int = TARGET, share: int = SHARE) -> DataFrame:
    """(source, block, slot, to_source, to_block, to_slot, queue_index) of each file: the result that it goes to.

    ``files`` are (source, block, slot, candidate, dirty, bytes, live_bytes), each once. Groups of
    candidates of two or more files, or of a dirty one, queue; a file of a group in the queue's
    prefix goes to the group's first file, any other stays and has a null index.
    """
    files = settled(files)
    own = files.where("candidate").select(*FILE, "dirty", "bytes").join(groups_of(files.where("candidate"), target), FILE)
    own = settled(own)
    groups = own.groupBy(*[F.col(f"first_{c}").alias(c) for c in FILE]).agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"), F.bool_or("dirty").alias("dirty"))
    chosen = queue_prefix(settled(groups.where("n_files >= 2 OR dirty")), share)
    moved = own.join(chosen.select(*[F.col(c).alias(f"first_{c}") for c in FILE], "queue_index"), [f"first_{c}" for c in FILE])
    moved = moved.select(*FILE, *[F.col(f"first_{c}").alias(f"to_{c}") for c in FILE], "queue_index")
    kept = files.join(moved.select(*FILE), FILE, "left_anti").select(*FILE, *[F.col(c).alias(f"to_{c}") for c in FILE], F.lit(None).cast("long").alias("queue_index"))
    return settled(moved.union(kept))


_TO = [f"to_{c}" for c in FILE]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(to_source, to_block, to_slot, line) sorted by file → the hash of each file's lines."""
    key, own = None, None
    for batch in batches:
        out = []
        for *now, line in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if key is not None:
                    out.append((*key, own.hexdigest()))
                key, own = now, hashlib.sha256()
            own.update(line)
        yield _rows(out)
    if key is not None:
        yield _rows([(*key, own.hexdigest())])


def _rows(found: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 4, kinds)], [*_TO, "live_sha256"])


def content_hashes(live: DataFrame, to: DataFrame) -> DataFrame:
    """(to_source, to_block, to_slot, live_sha256) of the results that have live rows.

    ``live`` are (source, block, slot, doc_id, text); a result's rows are hashed in order of id
    and text as lines ``id:text``, streamed through the hash.
    """
    line = F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text", F.lit("\n")), "UTF-8").alias("line")
    moved = live.join(to.select(*FILE, *_TO), FILE).select(*_TO, "doc_id", "text")
    dealt = moved.repartition(*_TO).sortWithinPartitions(*_TO, "doc_id", "text").select(*_TO, line)
    return dealt.mapInArrow(_hashed, "to_source string, to_block long, to_slot long, live_sha256 string")


def dealt_rows(docs: DataFrame, block_rows: int = 2000) -> DataFrame:
    """Documents as rows of files: (source, block, slot, doc_id, text, deleted, size), by the CRC-32 of their decimal id.

    Null source or text is empty; a null id is written as nothing and lies in block -1.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    block = F.coalesce(F.floor(F.col("doc_id") / block_rows), F.lit(-1)).cast("long")
    slot = F.least(h % 8, F.floor(h / 8) % 8).cast("long")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("source"), block.alias("block"), slot.alias("slot"), "doc_id", text.alias("text"), h.alias("h"))
    deleted = F.floor(F.col("h") / 64) % 100 < 9 * F.pmod(F.col("slot") + F.col("block"), F.lit(8))
    return rows.select(*FILE, "doc_id", "text", deleted.alias("deleted"), F.octet_length("text").cast("long").alias("size"))


def compact(rows: DataFrame, target: int = TARGET, share: int = SHARE) -> DataFrame:
    """One row per rewritten group or untouched file of ``rows`` (source, block, slot, doc_id, text, deleted, size).

    (source, block, slot) is the group's first file. Files are dirty if a fifth of their rows is
    deleted, small below three quarters of the target. ``cost`` and ``wave`` are null for an
    untouched file. Repeated rows count as rows; no rows, no files.
    """
    live = F.when(~F.col("deleted"), F.col("size")).otherwise(0)
    files = rows.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"), F.count_if("deleted").alias("n_deleted"), F.sum(live).alias("live_bytes")
    )
    dirty, small = F.col("n_deleted") * 100 >= F.col("n_rows") * 20, F.col("bytes") * 4 < 3 * target
    files = settled(files.withColumn("dirty", dirty).withColumn("candidate", dirty | small))
    to = plan(files.select(*FILE, "candidate", "dirty", "bytes", "live_bytes"), target, share)
    totals = files.join(to, FILE).groupBy(*_TO).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.col("n_rows") - F.col("n_deleted")).alias("live_rows"), F.sum("bytes").alias("bytes"),
        F.sum("live_bytes").alias("live"), F.max("queue_index").alias("queue_index"),
    )
    hashes = content_hashes(rows.where("NOT deleted").select(*FILE, "doc_id", "text"), to)
    cost = F.when(F.col("queue_index").isNotNull(), F.col("bytes") + F.col("live") + F.col("n_files") * OPEN_COST)
    return totals.join(hashes, _TO, "left").select(
        F.col("to_source").alias("source"), F.col("to_block").alias("block"), F.col("to_slot").alias("slot"), "n_files", "live_rows", "bytes", cost.alias("cost"),
        F.floor(F.col("queue_index") / WAVE).cast("long").alias("wave"), F.coalesce("live_sha256", F.lit(hashlib.sha256().hexdigest())).alias("live_sha256"),
    )


def op11_compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for the files that ``documents`` is dealt into."""
    return compact(dealt_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")))


_H = crc32_sql("coalesce(doc_id::VARCHAR, '')")
ORACLE_SQL = {
    "op11_compaction_plan": f"""
WITH RECURSIVE {TABLE}, hashed AS (
  SELECT coalesce(source, '') AS source, coalesce(floor(doc_id / 2000)::BIGINT, -1) AS block, doc_id, coalesce(text, '') AS text, {_H} AS h FROM documents, crc_table
), placed AS (
  SELECT *, least(h % 8, (h // 8) % 8) AS slot, strlen(text) AS size FROM hashed
), dealt AS (
  SELECT *, (h // 64) % 100 < 9 * (((slot + block) % 8 + 8) % 8) AS deleted FROM placed
), files AS (
  SELECT source, block, slot, count(*) AS n_rows, sum(size) AS bytes, count(*) FILTER (deleted) AS n_deleted, coalesce(sum(size) FILTER (NOT deleted), 0) AS live,
         100 * count(*) FILTER (deleted) >= 20 * count(*) AS dirty FROM dealt GROUP BY ALL
), candidates AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY block, slot) AS i FROM files WHERE dirty OR 4 * bytes < 3 * 32768
), fold AS (
  SELECT source, i, live AS open, block AS to_block, slot AS to_slot FROM candidates WHERE i = 1
  UNION ALL
  SELECT c.source, c.i, CASE WHEN f.open + c.live > 32768 THEN c.live ELSE f.open + c.live END,
         CASE WHEN f.open + c.live > 32768 THEN c.block ELSE f.to_block END, CASE WHEN f.open + c.live > 32768 THEN c.slot ELSE f.to_slot END
  FROM fold f JOIN candidates c ON c.source = f.source AND c.i = f.i + 1
), groups AS (
  SELECT source, to_block, to_slot, count(*) AS n_files, sum(bytes) AS bytes, bool_or(dirty) AS dirty FROM fold JOIN candidates USING (source, i) GROUP BY ALL
), queue AS (
  SELECT *, row_number() OVER w - 1 AS idx, sum(bytes) OVER (ORDER BY n_files DESC, bytes, source, to_block, to_slot ROWS UNBOUNDED PRECEDING) AS up_to, sum(bytes) OVER () AS whole
  FROM groups WHERE n_files >= 2 OR dirty WINDOW w AS (ORDER BY n_files DESC, bytes, source, to_block, to_slot)
), target AS (
  SELECT c.source, c.block, c.slot, f.to_block, f.to_slot, q.idx FROM fold f JOIN candidates c USING (source, i)
  JOIN queue q ON q.source = f.source AND q.to_block = f.to_block AND q.to_slot = f.to_slot WHERE 100 * q.up_to <= 50 * q.whole
), whole AS (
  SELECT f.*, coalesce(t.to_block, f.block) AS to_block, coalesce(t.to_slot, f.slot) AS to_slot, t.idx FROM files f LEFT JOIN target t USING (source, block, slot)
), results AS (
  SELECT source, to_block, to_slot, count(*) AS n_files, sum(n_rows - n_deleted) AS live_rows, sum(bytes) AS bytes, sum(live) AS live, max(idx) AS idx FROM whole GROUP BY ALL
), contents AS (
  SELECT d.source, w.to_block, w.to_slot, sha256(string_agg(coalesce(d.doc_id::VARCHAR, '') || ':' || d.text || chr(10), '' ORDER BY d.doc_id NULLS FIRST, d.text)) AS live_sha256
  FROM dealt d JOIN whole w USING (source, block, slot) WHERE NOT d.deleted GROUP BY ALL
)
SELECT source, to_block AS block, to_slot AS slot, n_files, live_rows::BIGINT AS live_rows, bytes::BIGINT AS bytes,
       CASE WHEN idx IS NOT NULL THEN (bytes + live + 4096 * n_files)::BIGINT END AS cost, idx // 16 AS wave, coalesce(live_sha256, sha256('')) AS live_sha256
FROM results LEFT JOIN contents USING (source, to_block, to_slot)""",
}
