"""WARC archives packaged in ZIP files: writer, and a reader that works by range reads.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member a
record, and ``indexes/index.jsonl`` with each record's place in it. The reader finds the
end record, the ZIP64 directory where there is one, and the members' places from the
central directory; then it reads the index and single records by their byte ranges,
without extracting anything.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import new_folder, settled

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Bytes of records after which a task starts the next package.
ROLL_BYTES = 32_000_000
#: Payloads from this size on are written once; equal ones revisit.
REVISIT_FROM = 1000
_DATE = "2024-01-01T00:00:00Z"


class BadZip(ValueError):
    """The bytes are not a package that can be read."""


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", uri))


def _read(file, start: int, size: int) -> bytes:
    file.seek(start)
    data = file.read(size)
    if len(data) != size:
        raise BadZip(f"{size} bytes wanted at {start}, {len(data)} found")
    return data


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name → (method, size, place of the local header) from the central directory."""
    tail_at = max(0, size - 65557)  # the end record and the longest comment
    tail = _read(file, tail_at, size - tail_at)
    end = len(tail)
    while True:
        end = tail.rfind(b"PK\5\6", 0, end)
        if end < 0:
            raise BadZip("no end record")
        if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        place, at = tail_at + end - 20, end - 20
        locator = tail[at : at + 20] if at >= 0 else b""
        if len(locator) < 20 and place >= 0:
            locator = _read(file, place, 20)
        if locator[:4] != b"PK\6\7":
            raise BadZip("no ZIP64 locator")
        record = _read(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\6\6":
            raise BadZip("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    entries = _read(file, start, length)
    found: dict[str, tuple[int, int, int]] = {}
    at = 0
    for _ in range(count):
        if entries[at : at + 4] != b"PK\1\2":
            raise BadZip(f"no directory entry at {at}")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", entries, at + 20)
        (place,) = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[at + 46 + n_name : at + 46 + n_name + n_extra]
        e = 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # the 64-bit values of those fields that are all ones, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                place = wide.pop(0) if place == 0xFFFFFFFF else place
            e += 4 + n
        found[name] = (method, packed, place)
        at += 46 + n_name + n_extra + n_comment
    return found


def member(file, entry: tuple[int, int, int]) -> tuple[int, int]:
    """(first byte, size) of a stored member's data."""
    method, size, place = entry
    if method:
        raise BadZip(f"a member is compressed by method {method}; only stored ones can be read by range")
    head = _read(file, place, 30)
    if head[:4] != b"PK\3\4":
        raise BadZip(f"no local header at {place}")
    return place + 30 + sum(struct.unpack_from("<HH", head, 26)), size


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _record(page: dict) -> bytes:
    """One record: headers of the archive, headers of HTTP, and the payload but for revisits."""
    payload = (page["html"] or "").encode("utf-8", "replace") if page["type"] == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['n']}\r\n\r\n".encode()
    kind = "response" if page["type"] == "response" else "revisit"
    uri = (page["url"] or f"urn:page:{page['page_id']}").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page['page_id']}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{_base32(page['sha1'])}",
    ]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{page['keep']}>")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + http + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise BadZip("not a record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise BadZip("a record is cut short")
    return headers, rest[:size]


def _package(records: bytes, index: list[dict]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as target:
            target.write(records)
        package.writestr(zipfile.ZipInfo(INDEX), "".join(json.dumps(x) + "\n" for x in index))
    return out.getvalue()


def _writer(folder: str):
    """Rows of pages → packages in ``folder``; a row (path, bytes, records) for each.

    Names are new for each attempt, so a repeated task never touches a file that counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        done: list[tuple[str, int, int]] = []
        records, index, size = [], [], 0

        def close() -> None:
            nonlocal records, index, size
            name = f"{uuid.uuid4().hex}.wacz"
            data = _package(b"".join(records), index)
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            done.append((f"{folder.rstrip('/')}/{name}", len(data), len(index)))
            records, index, size = [], [], 0

        for batch in batches:
            for at in range(batch.num_rows):
                page = {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}
                packed = gzip.compress(_record(page), 4, mtime=0)
                index.append({"page_id": page["page_id"], "offset": size, "length": len(packed)})
                records.append(packed)
                size += len(packed)
                if size >= ROLL_BYTES:
                    close()
        if index:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            ["path", "bytes", "records"],
        )

    return run


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, n, sha1, type, keep): what is written of each page.

    Payload is the html in UTF-8; null counts as empty. Of equal payloads of at least 1000
    bytes the largest page_id is the response; a null id is no response where others are
    not null. Rows repeated in id and payload share their type. Only ids and digests are
    grouped; an html moves once, by its page's id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("n"), F.sha1(payload).alias("sha1"))
    narrow = marked.where(F.col("n") >= REVISIT_FROM).select("page_id", "sha1")
    groups = narrow.groupBy("sha1").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("times")).where("times > 1 AND keep IS NOT NULL")
    again = narrow.join(groups, "sha1").where(~F.col("page_id").eqNullSafe(F.col("keep"))).select(F.col("page_id").alias("id"), F.col("sha1").alias("d"), "keep").distinct()
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("d"))
    kind = F.when(F.col("keep").isNull(), "response").otherwise("revisit")
    return marked.join(again, same, "left").select("page_id", "url", "html", "n", "sha1", kind.alias("type"), "keep")


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages; returns (path, bytes, records) of each.

    ``page_id`` is a whole number. ``folder`` is a URI that all executors share, of a file system
    that Arrow knows (file, hdfs, s3, gs, …); a new one below the session's shared folder by
    default. Paths keep its scheme. The list is settled, so packages are written once; they stay
    until the caller removes them. A package is built in memory: 32 MB of records, or one page
    where that is more.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    return settled(decide(pages).mapInArrow(_writer(folder), "path string, bytes long, records long"))


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
)


def _id(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").rpartition(":")[2]
    return int(text) if text not in ("", "None") else None


def read_package(file, size: int) -> Iterator[tuple]:
    """Rows of :data:`_RECORD` for the records of one package, by range reads."""
    entries = directory(file, size)
    if DATA not in entries or INDEX not in entries:
        raise BadZip("a member is missing")
    begin, _ = member(file, entries[DATA])
    at, length = member(file, entries[INDEX])
    for line in _read(file, at, length).splitlines():
        place = json.loads(line)
        headers, block = parse_record(gzip.decompress(_read(file, begin + place["offset"], place["length"])))
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = headers["warc-type"]
        if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
            raise BadZip(f"record {headers['warc-record-id']} doesn't have its digest")
        yield _id(headers["warc-record-id"]), n, digest, kind, _id(headers.get("warc-refers-to")), headers["warc-target-uri"], payload if kind == "response" else None


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _RECORD if payloads else pa.schema(list(_RECORD)[:-1])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = _store(path)
                rows, held = [], 0
                with store.open_input_file(place) as file:
                    for row in read_package(file, file.size()):
                        rows.append(row[: len(schema)])
                        held += row[1] if payloads else 64
                        if held > 16_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the packages in the column ``path``; with ``payloads``, also those.

    A package that can't be read fails the job with its reason.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return paths.select("path").mapInArrow(_reader(payloads), schema + (", payload binary" if payloads else ""))


def op3_warc_zip(spark, sf_dir: str) -> DataFrame:
    """All pages written to packages and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_archives(write_archives(pages)).drop("url")


ORACLE_SQL = {
    "op3_warc_zip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT d, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM p LEFT JOIN g USING (d)"""
}
