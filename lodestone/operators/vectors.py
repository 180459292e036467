"""Vector search: cosine, exact top-k, thresholds, pairs, and an inverted-list index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators.dedup import greedy_keep
from lodestone.sources.shared import settled

#: Vectors that one block of a search broadcasts, about.
MAX_QUERIES = 10_000
#: Scores that a task holds at once, about.
MAX_CELLS = 1_000_000
#: Scores of edges that a task goes through, about.
TASK_CELLS = 100_000_000
#: Vectors of the first range of ids of :func:`greedy_distinct`, about.
FIRST = 4000


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for a zero norm or unequal lengths, null for a null vector."""
    a, b = (F.transform(x, lambda v: v.cast("double")) for x in (a, b))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def _unit(rows: list, size: int) -> np.ndarray:
    """Unit vectors in double; zeros for another length or no norm, nulls inside count as 0."""
    out = np.zeros((len(rows), size))
    for i, row in enumerate(rows):
        if len(row) == size:
            out[i] = [0.0 if x is None or x != x else x for x in row]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """:func:`_unit` of an Arrow list column without null rows."""
    lens = np.diff(column.offsets.to_numpy())
    if column.values.null_count == 0 and (lens == size).all():
        start = column.offsets[0].as_py()
        out = column.values.to_numpy(zero_copy_only=False)[start : start + size * len(column)].astype(np.float64).reshape(-1, size)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
    return _unit(column.to_pylist(), size)


def score_queries(
    vectors: DataFrame, searches: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float | None = None, k: int | None = None, by: str | None = None, nearest: bool = False
) -> DataFrame:
    """(query_id, id, other columns…, score): cosine of each vector with each query, by matrix products.

    ``searches`` has (query_id, query_vec); it is sent out in blocks of at most ``MAX_QUERIES``,
    so any number may be given, and each block takes one pass over the vectors. Null vectors
    have no score; a vector of another length or without a norm has 0. With ``least`` lower
    scores, with ``k`` all but what can be among the best k per query (and value of ``by``) of a
    task, and with ``nearest`` all but the best query of each vector in a block are left out
    before anything is shuffled; ties go to the smaller id. A task holds at most about
    ``MAX_CELLS`` scores at once.
    """
    spark = vectors.sparkSession
    rest = [c for c in vectors.columns if c not in (id_col, vec_col)]
    asked = searches.where("query_vec IS NOT NULL").select("query_id", "query_vec")
    blocks = max(1, -(-asked.count() * 2 // MAX_QUERIES))  # half full on average
    numbered = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("__v"), *rest)
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), *(numbered.schema[c] for c in ("id", *rest)), T.StructField("score", T.DoubleType())])
    kind, cells = to_arrow_type(schema["query_id"].dataType), MAX_CELLS
    out = None
    for part in range(blocks):
        share = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id", "query_vec"), F.lit(blocks)) == part)
        rows = sorted(share.collect(), key=lambda r: (r.query_id is None, r.query_id))  # at most about MAX_QUERIES
        sizes = sorted({len(r.query_vec) for r in rows})
        held = spark.sparkContext.broadcast([
            ([r.query_id for r in rows if len(r.query_vec) == n], _unit([r.query_vec for r in rows if len(r.query_vec) == n], n), n) for n in sizes
        ])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bank = [(pa.array(queries, kind), matrix, size, _Floor(k, len(queries))) for queries, matrix, size in held.value]
            step = max(1, cells // max([1, *(len(queries) for queries, _, _, _ in bank)]))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    for queries, matrix, size, floor in bank:
                        score = matrix @ _matrix(batch.column(1), size).T
                        np.round(score, 6, out=score)
                        score += 0.0
                        if nearest:
                            v = np.arange(batch.num_rows)
                            q = score.argmax(axis=0)  # the first of equals has the smallest id
                            if least is not None:
                                v = np.flatnonzero(score[q, v] >= least)
                                q = q[v]
                        else:
                            keep = np.ones(score.shape, bool) if least is None else score >= least
                            if k is not None:
                                keep &= floor.best(score, batch.column(0), batch.column(batch.schema.get_field_index(by)) if by else None)
                            q, v = np.nonzero(keep)
                        picked = batch.take(pa.array(v))
                        columns = [queries.take(pa.array(q)), picked.column(0), *(picked.column(i) for i in range(2, 2 + len(rest)))]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(score[q, v])], ["query_id", "id", *rest, "score"])

        scored = numbered.mapInArrow(run, schema)
        out = scored if out is None else out.union(scored)
    return out


class _Floor:
    """The best ``k`` scores of each query (and group) that a task has met; what is below them can't be among the best."""

    def __init__(self, k: int | None, queries: int):
        self.k, self.queries, self.held = k, queries, {}

    def best(self, score: np.ndarray, ids: pa.Array, groups: pa.Array | None) -> np.ndarray:
        """Which of a batch's scores can be among the best ``k``."""
        keep = np.zeros(score.shape, bool)
        by_id = pc.sort_indices(ids).to_numpy()
        encoded = groups.dictionary_encode() if groups is not None else None
        codes = encoded.indices.fill_null(-1).to_numpy() if groups is not None else np.zeros(len(ids), np.int64)
        for code in np.unique(codes):
            own = by_id[codes[by_id] == code]  # in the order of ids, so that a stable sort breaks ties
            part = score[:, own]
            name = encoded.dictionary[int(code)].as_py() if groups is not None and code >= 0 else None
            kept = self.held.get(name)
            # a score equal to the floor may have the smaller id; queries without any such score are done
            rows = np.arange(self.queries) if kept is None else np.flatnonzero((part >= kept[:, :1]).any(axis=1))
            part = part[rows]
            first = np.argsort(-part, axis=1, kind="stable")[:, : self.k]
            top = np.take_along_axis(part, first, axis=1)
            keep[rows[:, None], own[first]] = True if kept is None else top >= kept[rows, :1]
            if kept is None:
                if len(self.held) * self.queries * self.k >= MAX_CELLS:
                    continue  # of more groups every batch's best are given
                kept = self.held[name] = np.full((self.queries, self.k), -np.inf)
            both = np.concatenate([kept[rows], top], axis=1)
            kept[rows] = np.sort(both, axis=1)[:, -self.k :]
        return keep


def best_edges(edges: DataFrame, vectors: DataFrame, searches: DataFrame, k: int, least: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, src, dst, score): what can be among the best ``k`` of the edges (src, dst) for each query, by the mean score of their ends.

    Ends score as in :func:`score_queries`, to six digits; both must score 0 or more, and their mean,
    to six digits too, at least ``least``. Ties go to the smaller src, then dst, which are long.
    The edges carry the vectors of their ends, so no score of an end is shuffled; a task holds the best
    ``k`` edges of each query of a block and about ``MAX_CELLS`` scores, and gives only the former.
    """
    spark = edges.sparkSession
    asked = searches.where("query_vec IS NOT NULL").select("query_id", "query_vec")
    count = asked.count()
    blocks = max(1, -(-count * 2 // MAX_QUERIES))  # half full on average
    known = vectors.where(F.col(vec_col).isNotNull())
    ends = [known.select(F.col(id_col).alias(end), F.col(vec_col).alias(f"__{end}")) for end in ("src", "dst")]
    pairs = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    tasks = min(1000, max(1, -(-pairs.count() * count // TASK_CELLS)))
    wired = pairs.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", "__src", "__dst")
    wired = settled(wired.repartition(tasks, F.xxhash64("src", "dst")))
    kind, cells = to_arrow_type(asked.schema["query_id"].dataType), MAX_CELLS
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("score", T.DoubleType())])
    out = None
    for part in range(blocks):
        share = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id", "query_vec"), F.lit(blocks)) == part)
        rows = share.collect()  # at most about MAX_QUERIES
        sizes = sorted({len(r.query_vec) for r in rows})
        held = spark.sparkContext.broadcast([
            ([r.query_id for r in rows if len(r.query_vec) == n], _unit([r.query_vec for r in rows if len(r.query_vec) == n], n), n) for n in sizes
        ])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bank = [(pa.array(queries, kind), matrix, size, Best(k, len(queries))) for queries, matrix, size in held.value]
            step = max(1, min(2000, cells))  # many edges of few queries, so that few of the best are put in order anew
            some = max(1, cells // step)
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    src, dst = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    for _, matrix, size, best in bank:
                        ends = [_matrix(batch.column(i), size).T for i in (2, 3)]
                        for first in range(0, len(matrix), some):
                            one, two = (np.round(matrix[first : first + some] @ end, 6) for end in ends)
                            score = np.floor((one + two) / 2 * 1e6 + 0.5) / 1e6
                            q, v = np.nonzero((one >= 0) & (two >= 0) & (score >= least) & (score >= best.score[first : first + len(one), -1:]))
                            best.add(q + first, score[q, v], src[v], dst[v])
            for queries, _, _, best in bank:
                q, src, dst, score = best.rows()
                for at in range(0, len(q), 100_000):
                    cut = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(q[cut])), pa.array(src[cut]), pa.array(dst[cut]), pa.array(score[cut])], ["query_id", "src", "dst", "score"])

        found = wired.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


class Best:
    """The best ``k`` of each query that a task has met, with two numbers, by which ties go."""

    def __init__(self, k: int, queries: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.src, self.dst = np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64)

    def add(self, q: np.ndarray, value: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
        if not len(q):
            return
        own = np.unique(q)
        who = np.concatenate([np.repeat(own, self.k), q])
        value = np.concatenate([self.score[own].ravel(), value])
        one, two = np.concatenate([self.src[own].ravel(), src]), np.concatenate([self.dst[own].ravel(), dst])
        order = np.lexsort((two, one, -value, who))
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < self.k
        order, at = order[keep], (who[keep], place[keep])
        self.score[at], self.src[at], self.dst[at] = value[order], one[order], two[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q, n = np.nonzero(self.score > -np.inf)
        return q, self.src[q, n], self.dst[q, n], self.score[q, n]


def top_k(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """Best ``k`` per ``by`` with rank; ties go to the smaller id."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = 0) -> DataFrame:
    """(a, b, score) with a < b and score at least ``threshold`` (over 0), exact.

    Null vectors and vectors of different lengths make no pair.

    Blocks of vectors meet as matrices: each row goes to the blocks it must meet, so the
    shuffle is rows times blocks and no pair below the threshold leaves a task.
    """
    vectors = vectors.where(F.col(vec_col).isNotNull())
    n = vectors.count()
    blocks = max(1, int(np.ceil(n / 4000)))
    numbered = vectors.select(
        F.col(id_col).alias("id"), F.transform(F.col(vec_col), lambda v: v.cast("double")).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("blk")
    )
    cells = numbered.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    cells = cells.withColumn("cell", F.least("blk", "other") * blocks + F.greatest("blk", "other"))

    def meet(key, pdf):
        import pandas as pd

        low, high = divmod(int(key[0]), blocks)
        lens = pdf["v"].map(len)
        size = int(lens.max()) if len(pdf) else 1
        m = _unit([[*v, *[0.0] * (size - len(v))] for v in pdf["v"]], size)
        ids, blk = pdf["id"].to_numpy(), pdf["blk"].to_numpy()
        left, right = np.flatnonzero(blk == low), np.flatnonzero(blk == high)
        found = []
        for at in range(0, len(left), 1024):
            part = left[at : at + 1024]
            score = np.round(m[part] @ m[right].T, 6) + 0.0
            x, y = np.nonzero((score >= threshold) & (lens.to_numpy()[part][:, None] == lens.to_numpy()[right][None]))
            a, b = ids[part[x]], ids[right[y]]
            keep = a < b if low == high else a != b
            found.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": score[x, y][keep]}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "score": []})

    return cells.groupBy("cell").applyInPandas(meet, "a long, b long, score double")


def inverted_lists(vectors: DataFrame, lists: int, sample: int = 2000, vec_col: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, np.ndarray]:
    """(``vectors`` with ``list``, centroids): k-means on a bounded sample, every row indexed."""
    rows = vectors.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vec_col).collect()
    m = np.array([r[0] for r in rows], np.float64)
    centres = m[: min(lists, len(m))].copy()
    for _ in range(8):
        near = (m @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = m[near == c].mean(axis=0)
                centres[c] /= max(np.linalg.norm(centres[c]), 1e-12)
    return vectors.withColumn("list", nearest_lists(F.col(vec_col), centres, 1)[0]), centres


def nearest_lists(vector: Column, centres: np.ndarray, probes: int) -> Column:
    """Numbers of the ``probes`` lists whose centroids are nearest."""
    scored = F.array(*[F.struct((-cosine(vector, F.array(*[F.lit(float(x)) for x in c]))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return F.transform(F.slice(F.array_sort(scored), 1, probes), lambda x: x["i"])


def ann_top_k(vectors: DataFrame, searches: DataFrame, k: int, lists: int = 8, probes: int = 3) -> DataFrame:
    """(query_id, id, score, rank): approximate top-k by inverted lists, re-ranked exactly.

    Each list meets the queries that probe it as matrices, so no row for a vector and a query is shuffled.
    """
    indexed, centres = inverted_lists(vectors.where("embedding IS NOT NULL"), lists)
    indexed = settled(indexed.select("vec_id", "embedding", "list"))
    probed = settled(searches.where("query_vec IS NOT NULL").withColumn("list", F.explode(nearest_lists(F.col("query_vec"), centres, probes))))
    near = None
    for i in range(max(1, len(centres))):
        own = indexed.where(F.col("list") == i).drop("list")
        found = score_queries(own, probed.where(F.col("list") == i).drop("list"), k=k).select("query_id", "id", "score")
        near = found if near is None else near.union(found)
    return top_k(near, k, "query_id")


def greedy_distinct(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vectors`` in the order of ids without those that one kept before resembles (``threshold`` over 0 or more); ids must not repeat.

    Ranges of ids that double are taken in turn: each loses what a kept vector resembles, and only
    of what is left are pairs made. So not all pairs at the threshold are held, whose number is the
    square of the vectors. Null vectors resemble nothing, rows with a null id stay.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"))
    known = settled(rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL"))
    count, shares = known.count(), []
    while FIRST << len(shares) < count:
        shares.append((FIRST << len(shares)) / count)
    bounds = sorted({int(x) for x in known.approxQuantile("vec_id", shares, 1e-3)}) if shares else []
    kept = None
    for low, high in zip([None, *bounds], [*bounds, None]):
        new = known
        if low is not None:
            new = new.where(F.col("vec_id") >= low)
        if high is not None:
            new = new.where(F.col("vec_id") < high)
        if kept is not None:
            bank = kept.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
            hit = score_queries(new, bank, least=threshold, nearest=True).select(F.col("id").alias("vec_id")).distinct()
            new = settled(new.join(hit, "vec_id", "left_anti"))
        fresh = greedy_keep(new, similar_pairs(new, threshold), "vec_id")
        kept = settled(fresh if kept is None else kept.union(fresh.select(kept.columns)))
    other = vectors.where(F.col(id_col).isNull() | F.col(vec_col).isNull())
    return other.union(vectors.join(kept.select(F.col("vec_id").alias(id_col)), id_col, "left_semi").select(vectors.columns))
