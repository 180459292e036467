import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import isomedia as im


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 50, 192 * 51, 192 * 137 + 5])
def test_round_trip(n):
    data = bytes(i * 31 % 251 for i in range(n))
    payload = im.padded(data)
    assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.rstrip(b" ") == data.rstrip(b" ")
    media = im.mux_frames(payload)
    (track,) = im.read_tracks(media)
    assert im.read_samples(media, track) == payload
    found = im._probe(media)
    frames = len(payload) // 192
    assert (found["codec"], found["timescale"], found["duration"], found["n_samples"]) == ("raw", 25, frames, frames)
    for i, key in enumerate(found["keyframes"]):
        assert media[key["offset"] : key["offset"] + key["size"]] == payload[i * 12 * 192 : (i * 12 + 1) * 192]
    assert len(found["keyframes"]) == -(-frames // 12)


def test_variable_sizes_long_boxes_and_no_stss():
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + 30) + bytes(range(30))
    sizes = [5, 7, 3, 8]
    stbl = im._box(
        b"stbl",
        im._full(b"stsd", struct.pack(">I", 1), im._box(b"avc1", bytes(78))),
        im._full(b"stsc", struct.pack(">I", 2), struct.pack(">6I", 1, 3, 1, 2, 1, 1)),
        im._full(b"stsz", struct.pack(">6I", 0, 4, *sizes)),
        im._full(b"co64", struct.pack(">I", 2), struct.pack(">2Q", 16, 16 + 20)),
    )
    mdhd = im._full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 1000, 4000, 0, 0), version=1)
    moov = im._box(b"moov", im._box(b"trak", im._box(b"mdia", mdhd, im._full(b"hdlr", bytes(4), b"vide", bytes(12)), im._box(b"minf", stbl))))
    found = im._probe(mdat + moov)
    assert (found["codec"], found["duration"], found["timescale"]) == ("avc1", 4000, 1000)
    assert [(k["offset"], k["size"]) for k in found["keyframes"]] == [(16, 5), (21, 7), (28, 3), (36, 8)]


@pytest.mark.parametrize("bad", [b"", b"abc", b"\0\0\0\7moov", im._box(b"moov"), im.mux_frames(b"x" * 192)[:-1], im.mux_frames(b"x" * 19200)[:300]])
def test_bad_media_is_told(bad):
    assert im._probe(bad)["error"]


def test_columns(spark):
    rows = [(1, "é" * 100, "f"), (1, "é" * 100, "f"), (2, None, "f"), (None, "", None), (3, "word " * 50000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    out = df.select("doc_id", "text", im.store(F.col("text").cast("binary")).alias("m")).select("*", im.samples(F.col("m")).alias("p"), im.probe(F.col("m")).alias("i")).collect()
    for r in out:
        want = im.padded((r.text or "").encode())
        assert bytes(r.p) == want and r.i.n_samples == len(want) // 192 and r.i.error is None
    digest = df.select(im._features_column("text").alias("f"), "text").select("f.*", "text").collect()
    for r in digest:
        want = im.padded((r.text or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    none = spark.createDataFrame([(None,)], "m binary")
    assert none.select(im.probe(F.col("m")).alias("i"), im.samples(F.col("m")).alias("s")).collect()[0] == (None, None)


def test_malformed_files_give_an_error():
    good = im.mux_frames(im.padded(b"x" * 192 * 60))
    at = good.index(b"stsc") + 12
    assert im._probe(good)["n_samples"] == 60
    for first, second in ((2, 1), (1, 1), (0, 2), (1, 9)):
        bad = bytearray(good)
        bad[at : at + 4], bad[at + 12 : at + 16] = first.to_bytes(4, "big"), second.to_bytes(4, "big")
        assert "order" in im._probe(bytes(bad))["error"]
    deep = b""
    for _ in range(3000):
        deep = im._box(b"moov", deep)
    assert "deep" in im._probe(deep)["error"]
    fragmented = im._box(b"ftyp", b"isom") + im._box(b"moov", im._box(b"trak")) + im._box(b"moof", im._box(b"traf")) + im._box(b"mdat", b"x")
    assert "fragmented" in im._probe(fragmented)["error"]
    with pytest.raises(im.BadMedia):
        im.read_tracks(fragmented)
