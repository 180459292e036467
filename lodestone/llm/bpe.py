"""Byte-level BPE by merge replay over a block of words.

Texts are cut by the vocabulary's pattern; the distinct unseen words of many texts, up to a
stated size, form one small corpus. An inverted index leads from a pair of adjacent tokens to its positions in that
corpus, a heap holds the ranks of the pairs that occur, and each merge is applied to all
its positions at once, touching only the neighbours of what it joins. Known words are kept
in a bounded table across blocks, so a word is replayed once per worker, not per use.
Nothing is shuffled: the vocabulary of ranks is a file that each worker reads from the
broadcast bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose ids a worker keeps, and their bytes (each counted as 16 more); beyond either, rare words are forgotten.
KNOWN_WORDS, KNOWN_BYTES = 250_000, 16_000_000
#: Bytes of unseen words (each counted as 16 more) that one replay takes on; words that wait for it; words of one part of a long text.
UNSEEN_BYTES, HELD_WORDS, PART_WORDS = 4_000_000, 4_000_000, 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes → rank of a tiktoken rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


#: Characters whose classes the two regular expression modules agree on: no separators
#: 1C-1F and no digits that are not decimal.
_PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*").fullmatch


def _cutter(pattern: str) -> tuple[Callable[[str], list[str]], Callable]:
    """``findall`` and ``finditer`` of the pattern; texts of plain characters take the faster module for the first."""
    compiled = regex.compile(pattern)
    every = compiled.findall
    classes = {r"[^\s\p{L}\p{N}]": r"(?:[^\s\w]|_)", r"\p{L}": r"[^\W\d_]", r"\p{N}": r"\d"}
    for one, other in classes.items():
        pattern = pattern.replace(one, other)
    if "\\p" in pattern or "(?i" in pattern:
        return every, compiled.finditer
    plain = re.compile(pattern).findall
    return lambda text: plain(text) if _PLAIN(text) else every(text), compiled.finditer


class _Numbers(dict):
    """word → number, given out in order of first sight; ``unseen`` adds up the size of new words."""

    unseen = 0

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.unseen += len(word) + 16
        return number


def _ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + len], one after another."""
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.arange(ends[-1]) + np.repeat(starts - ends + lens, lens)]


class Codec:
    """Encoder and decoder for one rank table and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.words, self.each = _cutter(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs[a << 32 | b] = rank
        self.pair_codes = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[c] for c in self.pair_codes.tolist()], np.int64)
        del pairs
        ids = np.array(sorted(ranks.values()), np.int64)
        by_id = {i: t for t, i in ranks.items()}
        self.piece_lens = np.zeros(ids[-1] + 1, np.int64)
        self.piece_lens[ids] = [len(by_id[i]) for i in ids.tolist()]
        self.piece_starts = np.cumsum(self.piece_lens) - self.piece_lens
        self.piece_bytes = np.frombuffer(b"".join(by_id[i] for i in ids.tolist()), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Start the table of known words anew."""
        self.known = _Numbers()
        self.known_bytes = 0
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int32)
        self.tokens = np.zeros(0, np.uint32)

    def _thin(self) -> None:
        """Keep the known words that have come up again; the rest are learnt anew if they do."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > KNOWN_WORDS // 2:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: KNOWN_WORDS // 2])
        words = list(self.known)
        self.known_bytes = sum(len(words[i]) + 16 for i in keep.tolist())
        if self.known_bytes > KNOWN_BYTES // 2:
            return self.forget()
        self.known = _Numbers((words[i], n) for n, i in enumerate(keep.tolist()))
        self.tokens = _ragged(self.tokens, self.starts[keep], self.lens[keep])
        self.lens, self.uses = self.lens[keep], self.uses[keep]
        self.starts = np.cumsum(self.lens, dtype=np.int64) - self.lens

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of adjacent tokens, -1 where they don't merge."""
        code = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all token ids, number of ids of each word): merges in rank order, leftmost first.

        Where a merge brings up one of lower rank, which trained tables hardly ever do, the
        word is replayed by itself, step by step.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        token = self.single[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        n = len(token)
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        ends = np.cumsum(sizes)
        right = np.arange(1, n + 1, dtype=np.int32)
        right[ends[sizes > 0] - 1] = -1
        left = np.arange(-1, n - 1, dtype=np.int32)
        left[(ends - sizes)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}  # by rank: positions of the pairs that spell that token
        heap: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.concatenate([[0], np.flatnonzero(rank[1:] != rank[:-1]) + 1])
            for r, part in zip(rank[cuts].tolist(), np.split(at, cuts[1:])):
                if (where := index.get(r)) is None:
                    index[r] = [part]
                    heapq.heappush(heap, r)
                else:
                    where.append(part)

        at = np.flatnonzero(right >= 0).astype(np.int32)
        rank = self._rank(token[at], token[right[at]])
        add(at[rank >= 0], rank[rank >= 0])
        del at, rank
        odd = np.zeros(len(words), bool)
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[(token[at] >= 0) & (right[at] >= 0)]
            at = at[self._rank(token[at], token[right[at]]) == rank]  # others lost a neighbour meanwhile
            if not len(at):
                continue
            nxt = right[at]
            if (at[1:] == nxt[:-1]).any():  # pairs that overlap, as in a run of one letter: every second one
                begin = np.flatnonzero(np.r_[True, at[1:] != nxt[:-1]])
                run = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
                at, nxt = at[run % 2 == 0], nxt[run % 2 == 0]
            after = right[nxt]
            next_too = np.flatnonzero(after[:-1] == at[1:])  # two in a row: what the first would see before the second
            if len(next_too):
                seen = self._rank(np.full(len(next_too), rank), token[after[next_too]])
                odd[word_of[at[next_too[(seen >= 0) & (seen < rank)]]]] = True
            token[at], token[nxt] = rank, -1
            right[at], right[nxt] = after, -1
            left[after[after >= 0]] = at[after >= 0]
            before = left[at]
            touched = np.concatenate([before[before >= 0], at[after >= 0]])
            if len(touched):
                touched = np.unique(touched)
                new = self._rank(token[touched], token[right[touched]])
                odd[word_of[touched[(new >= 0) & (new < rank)]]] = True
                add(touched[new > rank], new[new > rank])
        alive = token >= 0
        ids, counts = token[alive], np.bincount(word_of[alive], minlength=len(words))
        if odd.any():
            split = np.split(ids, np.cumsum(counts)[:-1])
            for w in np.flatnonzero(odd).tolist():
                split[w] = np.array(self._alone(words[w]), np.int64)
            ids, counts = np.concatenate(split), np.array([len(x) for x in split])
        return ids, counts

    def _alone(self, word: bytes) -> list[int]:
        """One word's ids, by the lowest and then leftmost merge each time."""
        parts = [bytes([b]) for b in word]
        while True:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None),
                default=None,
            )
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def _learn(self, words: list[str]) -> None:
        """Ids of the words that were numbered last."""
        spelled = [w.encode("utf-8", "replace") for w in words]
        whole = np.array([self.ranks.get(w, -1) for w in spelled], np.int64)
        ids, counts = self.replay([b"" if r >= 0 else w for w, r in zip(spelled, whole.tolist())])
        counts = np.where(whole >= 0, 1, counts)
        starts = np.cumsum(counts) - counts
        flat = np.empty(counts.sum(), np.uint32)
        held = np.repeat(whole >= 0, counts)
        flat[held], flat[~held] = whole[whole >= 0], ids
        self.starts = np.concatenate([self.starts, starts + len(self.tokens)])
        self.lens = np.concatenate([self.lens, counts.astype(np.int32)])
        self.tokens = np.concatenate([self.tokens, flat])

    def encode_block(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit; null counts as empty.

        Unseen words are gathered over texts, or over parts of a long one, and replayed as one
        corpus as soon as they make up :data:`UNSEEN_BYTES`; the table is thinned there too, so
        that neither grows with the block.
        """
        out: list[list[bytes]] = []
        waiting: list[tuple[int, np.ndarray]] = []
        self.held = 0
        for i, text in enumerate(texts):
            out.append([])
            for words in self._parts(text or ""):
                waiting.append((i, np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))))
                self.held += len(words)
                if self.known.unseen >= UNSEEN_BYTES or self.held >= HELD_WORDS:
                    self._flush(waiting, out)
        self._flush(waiting, out)
        return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]

    def _parts(self, text: str) -> Iterable[list[str]]:
        """The words of a text, :data:`PART_WORDS` at a time where it is long."""
        if len(text) <= PART_WORDS:
            words = self.words(text)
            if words:
                yield words
            return
        found = self.each(text)
        while words := [m.group() for m in islice(found, PART_WORDS)]:
            yield words

    def _flush(self, waiting: list[tuple[int, np.ndarray]], out: list[list[bytes]]) -> None:
        """Learn what is unseen, turn the waiting words into ids, and thin the table if it is full."""
        if self.known.unseen:
            self._learn(list(islice(self.known, len(self.lens), None)))
            self.known_bytes += self.known.unseen
            self.known.unseen = 0
        if waiting:
            flat = np.concatenate([w for _, w in waiting])
            self.uses = np.concatenate([self.uses, np.zeros(len(self.known) - len(self.uses), np.int32)])
            self.uses += np.bincount(flat, minlength=len(self.uses)).astype(np.int32)
            for i, numbers in waiting:
                out[i].append(_ragged(self.tokens, self.starts[numbers], self.lens[numbers]).astype("<u4", copy=False).tobytes())
            waiting.clear()
        self.held = 0
        if len(self.known) > KNOWN_WORDS or self.known_bytes > KNOWN_BYTES:
            self._thin()

    def encode(self, text: str | None) -> bytes:
        """Ids of one text."""
        return self.encode_block([text])[0]

    def decode(self, ids: bytes | None) -> bytes:
        """Bytes that the ids spell; an id outside the table raises IndexError."""
        which = np.frombuffer(ids or b"", "<u4")
        return _ragged(self.piece_bytes, self.piece_starts[which], self.piece_lens[which]).tobytes()


@lru_cache(maxsize=2)
def _codec(vocabulary: bytes, pattern: str) -> Codec:
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x.strip())}
    return Codec(ranks, pattern)


def functions(spark: SparkSession, path: str, pattern: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """(encode, decode) as column functions: text → ids binary, ids binary → bytes.

    ``path`` is read on the driver; its content (under 1 MB) is broadcast. Null text is
    taken as empty and gives empty ids; null ids give empty bytes.
    """
    with open(path, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf(T.BinaryType())
    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(vocabulary.value, pattern)
        return pa.array(codec.encode_block(t.as_py() for t in texts), pa.binary())

    @F.arrow_udf(T.BinaryType())
    def decode(ids: pa.Array) -> pa.Array:
        codec = _codec(vocabulary.value, pattern)
        return pa.array([codec.decode(x.as_py()) for x in ids], pa.binary())

    return encode, decode


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public multilingual byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the binary column ``out``: ids as little-endian unsigned 32-bit integers."""
    encode, _ = functions(docs.sparkSession, path, pattern)
    return docs.withColumn(out, encode(F.col(text_col)))


def decode_documents(docs: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the binary column ``out``: the bytes that ``ids_col`` spells."""
    _, decode = functions(docs.sparkSession, path, pattern)
    return docs.withColumn(out, decode(F.col(ids_col)))


def op2_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Encode all documents, decode the ids, and return the digests of both; a row per row."""
    path, pattern = default_vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = decode_documents(encode_documents(docs, path, pattern), path, pattern)
    return both.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
