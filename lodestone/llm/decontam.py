"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

Texts and items are words (lower-cased runs of letters and digits). Windows have as many words
as an item and begin at every stride-th word, a quarter of the item's shingles; their 64-bit
SimHashes come from running sums of bits, several to a machine word. Each of four blocks of 16
bits is looked up for its least distance to any item's block. Where the four add up to 19 bits
at most, and only there, whole fingerprints are compared, so every item fingerprint within 19
bits is found. A candidate is verified by the weighted Jaccard similarity of 5-word shingles of
all windows of its text, not only of those on the grid, so what is found is exact.

Of windows at a similarity of 0.8 the fingerprints are about 10 bits from the item's, at the
worst offset from the grid 14: 19 bits miss few (the tests measure it against all windows).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shingles import run_hashes, word_hashes
from lodestone.sources.shared import settled

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
#: Shingles of an item for each word of the stride.
STRIDE = 4
#: Items, and characters of them, that one pass over the documents holds in memory; more take more passes.
ITEMS_PER_PASS, CHARS_PER_PASS = 20_000, 4_000_000
#: Block tables of an index, 256 KB each; where there are more lengths, neighbours share one.
TABLES = 128
#: Words of texts that are searched at once; a longer text is cut into overlapping parts.
BLOCK_WORDS = 60_000
#: Characters from which a text's words are hashed one by one.
LONG = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_SPACED = bytes(c if chr(c).isalnum() else 32 for c in range(256))
_BLOCKS, _BITS = 4, 16


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(_SPACED).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


def _hashes(text: str | None) -> np.ndarray:
    if text and len(text) > LONG:
        return word_hashes(m.group() for m in _WORD.finditer(text.lower()))
    own = words(text)
    return word_hashes(own, len(own))


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """SimHash of shingle hashes, repeats included: a bit is 1 if set in over half of them."""
    raw = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(raw), bitorder="little").view("<u8")[0]


class Sums:
    """Running sums of the bits of hashes, for fingerprints of any windows of them.

    Row j adds up the bits j, j + width and so on, each in a lane of ``width`` bits. Lanes run
    over into each other, but the difference of two sums is right where no window's does.
    """

    def __init__(self, hashes: np.ndarray, width: int):
        self.width = width
        self.ones = np.uint64(sum(1 << k for k in range(0, 64, width)))
        self.rows = np.zeros((width, len(hashes) + 1), np.uint64)
        for j, row in enumerate(self.rows):
            np.cumsum((hashes >> np.uint64(j)) & self.ones, out=row[1:])

    @staticmethod
    def width_for(n: int) -> int:
        """Bits of a lane that holds up to ``n``."""
        return 8 if n < 1 << 8 else 16 if n < 1 << 16 else 32

    def prints(self, first: slice | np.ndarray, last: slice | np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Fingerprints of the ``n`` hashes from ``first`` up to ``last``."""
        half = 1 << self.width - 1
        top = self.ones * np.uint64(half)
        lift = self.ones * (np.uint64(half - 1) - np.uint64(n) // np.uint64(2))  # a lane's top bit is set from over half on
        out = None
        for row in self.rows:
            lane = row[last] - row[first]
            lane += lift
            lane &= top
            if out is None:
                out = lane
            else:
                out >>= np.uint64(1)
                out |= lane
        return out


class Known:
    """A set of hashes; a table of leading bits tells most others from them."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        bits = min(24, max(16, (16 * len(self.hashes)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.leading = np.zeros(1 << bits, bool)
        self.leading[self.hashes >> self.shift] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = self.leading[hashes >> self.shift]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        out[at] = self.hashes[place] == hashes[at]
        return out


def _distances(blocks: np.ndarray) -> np.ndarray:
    """For each value of 16 bits the number of bits to the nearest of the blocks."""
    out = np.full(1 << _BITS, _BITS, np.uint8)
    out[blocks] = 0
    for _ in range(2):
        for bit in range(_BITS // 2, _BITS):
            off, on = (out.reshape(-1, 2, 1 << bit)[:, side] for side in (0, 1))
            nearer = np.minimum(off, on + 1)
            on[:] = np.minimum(on, off + 1)
            off[:] = nearer
        out = out.reshape(1 << _BITS // 2, -1).T.ravel()  # the other half of the bits leads
    return out


class Item:
    """One item's shingles: distinct hashes in order, how often each comes, and how many in all."""

    def __init__(self, item_id, own: np.ndarray):
        self.id, self.words = item_id, len(own)
        self.size = min(SHINGLE, len(own))
        found = run_hashes(own, SHINGLE)
        self.n, self.fp = len(found), fingerprint(found)
        self.shingles, self.times = np.unique(found, return_counts=True)

    def best(self, own: np.ndarray, n_words: int) -> tuple[float, int]:
        """(similarity, first word) of the best window among shingles ``own`` of a text of so many words.

        Equal similarity goes to the first window. A shorter text is one window.
        """
        at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
        p = np.flatnonzero(self.shingles[at] == own)
        if not len(p):
            return 0.0, 0
        kind = at[p]
        if n_words < self.words:
            shared = int(np.minimum(np.bincount(kind, minlength=len(self.times)), self.times).sum())
            return shared / (len(own) + self.n - shared), 0
        order = np.argsort(kind, kind="stable")
        p, kind = p[order], kind[order]
        first = np.searchsorted(kind, kind)
        before = np.arange(len(p)) - self.times[kind]
        # an occurrence counts while the window holds less than the item's number of those before it
        low = np.maximum(np.where(before >= first, p[np.maximum(before, 0)] + 1, 0), np.maximum(p - self.n + 1, 0))
        last = n_words - self.words
        high = np.minimum(p, last)
        kept = low <= high
        change = np.zeros(last + 2, np.int64)
        np.add.at(change, low[kept], 1)
        np.add.at(change, high[kept] + 1, -1)
        shared = np.cumsum(change[:-1])
        start = int(np.argmax(shared))
        return float(shared[start] / (2 * self.n - shared[start])), start


class Length:
    """The items of one length, with their fingerprints; ``table`` has the distances of Hamming blocks."""

    def __init__(self, items: list[int], every: list[Item]):
        self.items = np.array(items)
        one = every[items[0]]
        self.words, self.size, self.n = one.words, one.size, one.n
        self.stride = max(1, self.n // STRIDE)
        self.width = Sums.width_for(self.n)
        self.prints = np.array([every[i].fp for i in items], np.uint64)
        self.table = None

    @staticmethod
    def share_table(lengths: list[Length]) -> None:
        """One table for these lengths: for each block's value the least distance to a block of an item."""
        blocks = np.concatenate([length.prints for length in lengths]).view(np.uint16).reshape(-1, _BLOCKS)
        table = np.stack([_distances(blocks[:, b]) for b in range(_BLOCKS)])
        for length in lengths:
            length.table = table

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which fingerprint, which of the items) for each two within the radius."""
        parts = prints.view(np.uint16).reshape(-1, _BLOCKS)
        apart = self.table[0].take(parts[:, 0])
        for block in range(1, _BLOCKS):
            apart += self.table[block].take(parts[:, block])
        at = np.flatnonzero(apart <= RADIUS)
        left = prints[at]
        close = [at[np.bitwise_count(left ^ p) <= RADIUS] for p in self.prints]
        return np.concatenate(close), np.repeat(np.arange(len(close)), [len(c) for c in close])

    def edges(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word in the stream, shingles) of each text's first and last window, or the whole of a shorter text."""
        room = sizes - self.words
        whole, short = np.flatnonzero(room >= 0), np.flatnonzero(room < 0)
        here = sizes[short] - self.size + 1
        kept = (here >= max(1, SIMILARITY * self.n - 1e-9)) & (self.words > SHINGLE)
        first = np.concatenate([starts[whole], starts[whole] + room[whole], starts[short[kept]]])
        return first, np.concatenate([np.full(2 * len(whole), self.n), here[kept]])

    def prints_of(self, sums: Sums, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows at every stride-th word of the stream, then of the windows given."""
        grid = max(0, sums.rows.shape[1] - self.n)
        regular = sums.prints(slice(0, grid, self.stride), slice(self.n, None, self.stride), self.n)
        return np.concatenate([regular, sums.prints(first, first + n, n)])


class Index:
    """Items of one pass, by length."""

    def __init__(self, items: list[tuple[object, str]]):
        found = ((item_id, _hashes(text)) for item_id, text in items)
        self.items = [Item(item_id, own) for item_id, own in found if len(own)]
        by_length: dict[int, list[int]] = {}
        for i, item in enumerate(self.items):
            by_length.setdefault(item.words, []).append(i)
        self.lengths = [Length(own, self.items) for _, own in sorted(by_length.items())]
        each = -(-len(self.lengths) // TABLES)
        for k in range(0, len(self.lengths), max(1, each)):
            Length.share_table(self.lengths[k : k + each])
        self.longest = max(by_length, default=0)
        self.known = {q: Known(np.concatenate([i.shingles for i in self.items if i.size == q])) for q in {i.size for i in self.items}}

    def search_all(self, texts: Iterable[str | None]) -> Iterator[tuple]:
        """(place of the text, item id, similarity, first word, words, distance): the best window of each item that passes."""
        waiting: list[tuple[int, int, np.ndarray]] = []
        held = 0
        step = max(BLOCK_WORDS, 2 * self.longest)
        for place, text in enumerate(texts):
            own = _hashes(text)
            if len(own) > step + self.longest:
                parts = [(place, a, own[a : a + step + self.longest]) for a in range(0, len(own) - self.longest, step)]
                best: dict[object, tuple] = {}
                for part in parts:
                    for found in self._search([part]):
                        known = best.get(found[-1])
                        if known is None or (-found[2], found[3]) < (-known[2], known[3]):
                            best[found[-1]] = found
                yield from (best[i][:-1] for i in sorted(best))
                continue
            if held + len(own) > step:
                yield from (f[:-1] for f in self._search(waiting))
                waiting, held = [], 0
            if len(own):
                waiting.append((place, 0, own))
                held += len(own)
        yield from (f[:-1] for f in self._search(waiting))

    def search(self, text: str | None) -> list[tuple]:
        """The same for one text, without its place."""
        return [f[1:] for f in self.search_all([text])]

    def _search(self, texts: list[tuple[int, int, np.ndarray]]) -> list[tuple]:
        """Results for (place, offset, word hashes) of some texts; the last field is the item's number."""
        if not texts or not self.items:
            return []
        stream = np.concatenate([t[2] for t in texts])
        sizes = np.array([len(t[2]) for t in texts])
        starts = np.cumsum(sizes) - sizes
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        pairs: set[tuple[int, int]] = set()
        runs, hits, sums = {}, {}, {}
        for length in self.lengths:
            q = length.size
            if q > len(stream):
                continue
            if q not in runs:
                runs[q] = run_hashes(stream, q)
                hits[q] = np.concatenate([[0], np.cumsum(self.known[q].has(runs[q]))])
            if (q, length.width) not in sums:
                sums[q, length.width] = Sums(runs[q], length.width)
            first, n = length.edges(starts, sizes)
            prints = length.prints_of(sums[q, length.width], first, n)
            regular = np.arange(len(prints) - len(first)) * length.stride
            first, n = np.concatenate([regular, first]), np.concatenate([np.full(len(regular), length.n), n])
            which, item = length.near(prints)
            first, n, text, here = first[which], n[which], text_of[first[which]], hits[q]
            # inside its text; and a window within half a stride that passes has most of its shingles from items
            low, high = np.maximum(first - length.stride, 0), np.minimum(first + n + length.stride, len(here) - 1)
            kept = (first + n + q - 1 <= starts[text] + sizes[text]) & (here[high] - here[low] >= SIMILARITY * n - 1e-9)
            pairs.update(zip(text[kept].tolist(), length.items[item[kept]].tolist()))
        out = []
        for at, number in sorted(pairs):
            item, (place, offset, own) = self.items[number], texts[at]
            shingles = runs[item.size][starts[at] : starts[at] + len(own) - item.size + 1]
            score, start = item.best(shingles, len(own))
            if score >= SIMILARITY - 1e-12:
                distance = int(np.bitwise_count(fingerprint(shingles[start : start + item.n]) ^ item.fp))
                out.append((place, item.id, round(score, 6), offset + start, item.words, distance, number))
        return out


def _passes(items: DataFrame) -> list[Callable]:
    """For each pass a function that gives its index broadcast, so that only one is held at a time."""
    spark = items.sparkSession
    kept = settled(items.where("text IS NOT NULL").select("item_id", "text"))
    rows, chars = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n = max(1, -(-rows // ITEMS_PER_PASS), -(-chars // CHARS_PER_PASS))

    def made(k: int):
        share = kept.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about ITEMS_PER_PASS rows
        return spark.sparkContext.broadcast(Index(sorted(((r.item_id, r.text) for r in share), key=lambda r: (r[0] is None, r))))

    return [lambda k=k: made(k) for k in range(n)]


_NAMES = ["id", "item_id", "similarity", "first_word", "n_words", "distance"]


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, similarity, first_word, n_words, distance) for each document and item that match.

    ``items`` has (item_id, text); it is taken in passes of at most a fixed number of items and
    characters, so any number may be given. Null and empty texts and items match nothing. Repeated
    rows are all searched; items with equal text all match.
    """
    kind = dict(docs.dtypes)[id_col]
    item_kind = dict(items.dtypes)["item_id"]
    out = None
    for made in _passes(items):
        index = made()

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                rows = list(index.value.search_all(t.as_py() for t in texts))
                which = ids.take(pa.array([r[0] for r in rows], pa.int32()))
                columns = [pa.array([r[c] for r in rows]) for c in range(1, 6)] if rows else [pa.array([], pa.int64())] * 5
                types = (None, pa.float64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([which, *(c.cast(t) if t else c for c, t in zip(columns, types))], _NAMES)

        schema = f"id {kind}, item_id {item_kind}, similarity double, first_word long, n_words long, distance int"
        found = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def _holds(index):
    @F.arrow_udf(T.BooleanType())
    def holds(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        out[[f[0] for f in index.value.search_all(t.as_py() for t in texts)]] = True
        return pa.array(out)

    return holds


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns stay.

    The search marks the row itself, so neither ids nor texts are shuffled.
    """
    for made in _passes(items):
        docs = docs.where(~_holds(made())(F.col(f"`{text_col}`")))
    return docs


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: one row per document and item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return matches(docs, items).withColumnRenamed("id", "doc_id")
