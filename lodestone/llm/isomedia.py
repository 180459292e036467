"""Media columns in ISO base media containers (ISO/IEC 14496-12).

``probe`` walks the nested boxes of a file, decodes the sample tables and stores codec,
duration and the byte ranges of the key frames; payloads are never decoded. ``mux_frames``
writes raw video: 8 by 8 RGB frames of 192 bytes, one sample each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

FRAME, RATE, KEY_EVERY, CHUNK_FRAMES = 192, 25, 12, 50
#: Boxes that hold boxes, as the standard has them.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


class BadMedia(ValueError):
    """The bytes are not a container that can be read."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes) -> bytes:
    """``data`` with blanks up to a positive multiple of a frame."""
    return data + b" " * (-len(data) % FRAME if data else FRAME)


def mux_frames(payload: bytes) -> bytes:
    """A file whose samples are the payload's frames; its length is a positive multiple of 192."""
    n = len(payload) // FRAME
    if not n or len(payload) % FRAME:
        raise ValueError("a payload is a positive multiple of a frame")
    chunks = -(-n // CHUNK_FRAMES)
    runs = [(1, min(n, CHUNK_FRAMES))]
    if chunks > 1 and n % CHUNK_FRAMES:
        runs.append((chunks, n % CHUNK_FRAMES))
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", 8, 8),
        struct.pack(">II", 0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 24, -1),
    )
    keys = np.arange(1, n + 1, KEY_EVERY)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES * FRAME
        wide = first + len(payload) >= 1 << 32
        table = _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes())
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, k, 1) for at, k in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            table,
        )
        link = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), link, stbl)
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
            minf,
        )
        track = _full(
            b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7
        )
        header = _full(
            b"mvhd", struct.pack(">IIII", 0, 0, RATE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)
        )
        return _box(b"moov", header, _box(b"trak", track, mdia))

    long = len(payload) + 8 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(ftyp) + len(moov(0)) + len(head)
    return b"".join((ftyp, moov(first), head, payload))


#: Boxes within boxes that are walked; the standard's own nesting has at most about ten.
DEEPEST = 64


def walk(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple, int, int]]:
    """(path, first byte of the body, end) of every box, parents before children; without recursion."""
    levels: list[tuple[int, int, tuple]] = [(start, len(data) if end is None else end, ())]  # place, end and path of each open box
    while levels:
        start, end, path = levels.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise BadMedia(f"{end - start} bytes left over at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise BadMedia(f"no room for a long size at {start}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise BadMedia(f"box {kind!r} at {start} has size {size}")
        yield (*path, kind), body, start + size
        levels.append((start + size, end, path))
        if kind in CONTAINERS:
            if len(path) >= DEEPEST:
                raise BadMedia(f"boxes are nested more than {DEEPEST} deep")
            levels.append((body, start + size, (*path, kind)))


@dataclass
class Track:
    """Decoded tables of one track."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _numbers(data: memoryview, at: int, end: int, kind: str, count: int) -> np.ndarray:
    if at + count * np.dtype(kind).itemsize > end:
        raise BadMedia("a table is cut short")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _u32(data: memoryview, at: int, end: int) -> int:
    return int(_numbers(data, at, end, ">u4", 1)[0])


def read_tracks(data: bytes) -> list[Track]:
    """Every track's tables; BadMedia where boxes or tables don't fit together."""
    view = memoryview(data)
    tracks: list[Track] = []
    tables: list[dict] = []
    for path, at, end in walk(view):
        kind = path[-1]
        if kind == b"moof":
            raise BadMedia("a fragmented file; its samples are not in the tables")
        if kind == b"trak":
            tracks.append(Track())
            tables.append({})
        if b"trak" not in path or at + 4 > end or kind in CONTAINERS:
            continue
        track, own = tracks[-1], tables[-1]
        if kind == b"mdhd":
            wide = view[at] == 1
            track.timescale = _u32(view, at + (20 if wide else 12), end)
            track.duration = int(_numbers(view, at + (24 if wide else 16), end, ">u8" if wide else ">u4", 1)[0])
        elif kind == b"hdlr":
            track.handler = bytes(view[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd" and _u32(view, at + 4, end):
            track.codec = bytes(view[at + 12 : at + 16]).decode("latin-1").strip()
        elif kind == b"stsz":
            size, count = _u32(view, at + 4, end), _u32(view, at + 8, end)
            if size and count * size > len(data):
                raise BadMedia("more samples than bytes")
            track.sizes = np.full(count, size, np.int64) if size else _numbers(view, at + 12, end, ">u4", count)
        elif kind == b"stsc":
            own["runs"] = _numbers(view, at + 8, end, ">u4", 3 * _u32(view, at + 4, end)).reshape(-1, 3)
        elif kind in (b"stco", b"co64"):
            own["chunks"] = _numbers(view, at + 8, end, ">u4" if kind == b"stco" else ">u8", _u32(view, at + 4, end))
        elif kind == b"stss":
            own["keys"] = _numbers(view, at + 8, end, ">u4", _u32(view, at + 4, end)) - 1
    for track, own in zip(tracks, tables):
        n, chunks = len(track.sizes), own.get("chunks", np.zeros(0, np.int64))
        if not n:
            continue
        runs = own.get("runs", np.zeros((0, 3), np.int64))
        if not len(runs) or not len(chunks):
            raise BadMedia("samples without chunks")
        lengths = np.diff(np.r_[runs[:, 0] - 1, len(chunks)])
        if runs[0, 0] != 1 or (lengths <= 0).any():
            raise BadMedia("runs of chunks are out of order")
        per = np.repeat(runs[:, 1], lengths)
        if per.sum() != n or len(per) != len(chunks):
            raise BadMedia("chunks and samples differ in number")
        ends = np.cumsum(track.sizes)
        first = np.cumsum(per) - per
        within = ends - track.sizes
        track.offsets = np.repeat(chunks - within[np.minimum(first, n - 1)], per) + within
        if (track.offsets + track.sizes).max() > len(data):
            raise BadMedia("samples beyond the end")
        track.keys = own.get("keys", np.arange(n))
        if len(track.keys) and (track.keys.min() < 0 or track.keys.max() >= n):
            raise BadMedia("key frames beyond the samples")
    return tracks


def read_samples(data: bytes, track: Track) -> bytes:
    """The track's samples one after another; runs that lie together are read at once."""
    if not len(track.sizes):
        return b""
    gaps = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    begin, last = np.r_[0, gaps], np.r_[gaps, len(track.sizes)] - 1
    return b"".join(data[track.offsets[a] : track.offsets[b] + track.sizes[b]] for a, b in zip(begin, last))


_RANGE = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
_PROBED = pa.struct(
    [("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()),
     ("n_samples", pa.int64()), ("keyframes", _RANGE), ("error", pa.string())]
)


def _probe(data: bytes | None) -> dict | None:
    if data is None:
        return None
    try:
        tracks = read_tracks(data)
        if not tracks:
            raise BadMedia("no track")
    except BadMedia as bad:
        return {"error": str(bad)}
    track = next((t for t in tracks if t.handler == "vide"), tracks[0])
    ranges = zip(track.offsets[track.keys].tolist(), track.sizes[track.keys].tolist())
    return {
        "codec": track.codec, "handler": track.handler, "timescale": track.timescale, "duration": track.duration,
        "n_samples": len(track.sizes), "keyframes": [{"offset": o, "size": s} for o, s in ranges],
    }


@F.arrow_udf(from_arrow_type(_PROBED))
def _probe_column(media: pa.Array) -> pa.Array:
    return pa.array([_probe(x.as_py()) for x in media], _PROBED)


@F.arrow_udf(T.BinaryType())
def _store_column(payload: pa.Array) -> pa.Array:
    return pa.array([mux_frames(padded(x.as_py() or b"")) for x in payload], pa.binary())


def _samples(data: bytes | None) -> bytes | None:
    if data is None:
        return None
    try:
        tracks = read_tracks(data)
    except BadMedia:
        return None
    return read_samples(data, tracks[0]) if tracks else None


@F.arrow_udf(T.BinaryType())
def _samples_column(media: pa.Array) -> pa.Array:
    return pa.array([_samples(x.as_py()) for x in media], pa.binary())


def store(payload: Column) -> Column:
    """A container holding the bytes, padded with blanks; null is stored as no bytes."""
    return _store_column(payload)


def probe(media: Column) -> Column:
    """Codec, duration and key-frame ranges of the first video track, else the first track.

    Null media gives null; bytes that can't be read give nulls and ``error``.
    """
    return _probe_column(media)


def samples(media: Column) -> Column:
    """The first track's sample bytes read back through its tables; null for null and for what can't be read."""
    return _samples_column(media)


_FEATURES = pa.struct(
    [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
     ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def _features(text: str | None) -> dict:
    media = mux_frames(padded((text or "").encode("utf-8", "replace")))
    probed = _probe(media)
    read = read_samples(media, read_tracks(media)[0])
    ranges = hashlib.sha256("".join(f"{k['offset']}:{k['size']}," for k in probed["keyframes"]).encode()).hexdigest()
    return {
        "payload_bytes": len(read), "payload_sha256": hashlib.sha256(read).hexdigest(), "tail_crc32": zlib.crc32(read[-16:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"{probed['codec']} {probed['duration']}/{probed['timescale']}s samples={probed['n_samples']} "
        f"keyframes={len(probed['keyframes'])} ranges={ranges[:16]}",
    }


@F.arrow_udf(from_arrow_type(_FEATURES))
def _features_column(texts: pa.Array) -> pa.Array:
    return pa.array([_features(x.as_py()) for x in texts], _FEATURES)


def op7_isomedia_columns(spark, sf_dir: str) -> DataFrame:
    """Every document stored as a container in memory, read back and described.

    Storing, walking and reading run in one pass, so that the container's bytes need not
    travel; null texts count as empty.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), _features_column("text").alias("f")
    ).select("doc_id", "n_bytes", "f.*")
