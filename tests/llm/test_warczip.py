import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from lodestone.llm import warczip as wz


def test_directory_with_comment_and_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open(zipfile.ZipInfo("a/b.bin"), "w", force_zip64=True) as f:
            f.write(b"x" * 70000)
        z.writestr(zipfile.ZipInfo("é.txt"), b"hello")
        z.comment = b"PK\5\6 not the end"
    data = out.getvalue()
    found = wz.directory(io.BytesIO(data), len(data))
    assert set(found) == {"a/b.bin", "é.txt"}
    at, n = wz.member(io.BytesIO(data), found["é.txt"])
    assert data[at : at + n] == b"hello"


def test_many_members_need_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"{i}"), b"")
    data = out.getvalue()
    assert len(wz.directory(io.BytesIO(data), len(data))) == 66_000


@pytest.mark.parametrize("bad", [b"", b"PK", b"x" * 100])
def test_bad_packages(bad):
    with pytest.raises(wz.BadZip):
        wz.directory(io.BytesIO(bad), len(bad))


def test_round_trip(spark, monkeypatch):
    big, small = "é" * 600, "tiny"
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""),
            (8, "u", "z" * 999), (9, "u", "z" * 999), (10, "u", "q" * 1000), (10, "u", "q" * 1000), (None, "u", big), (11, "u", "w" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, n string")
    got = wz.read_archives(wz.write_archives(df), payloads=True).collect()
    assert len(got) == len(rows)
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        again = len(data) >= 1000 and page_id != max(same)
        want.append((str(page_id), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", str(max(same)) if again else "None"))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert wz.read_archives(wz.write_archives(df.limit(0))).collect() == []


def test_paths_keep_the_scheme(monkeypatch, tmp_path):
    """A store that isn't the local disk: writer and reader both go by the URI."""
    asked = []

    def store(uri):
        asked.append(uri)
        assert uri.startswith("far://bucket/dir")
        return wz.fs.SubTreeFileSystem(str(tmp_path), wz.fs.LocalFileSystem()), uri.removeprefix("far://bucket/")

    monkeypatch.setattr(wz, "_store", store)
    page = pa.RecordBatch.from_pylist([{"page_id": 7, "url": "u", "html": "x" * 5, "n": 5, "sha1": hashlib.sha1(b"x" * 5).hexdigest(), "type": "response", "keep": None}])
    (listed,) = wz._writer("far://bucket/dir/")([page])
    assert listed["path"][0].as_py().startswith("far://bucket/dir/") and len(list((tmp_path / "dir").iterdir())) == 1
    (back,) = wz._reader(True)([listed.select(["path"])])
    assert back.to_pylist()[0]["payload"] == b"xxxxx" and len(asked) == 2


def test_local_forms_of_a_folder(tmp_path):
    for form in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        assert wz._store(form)[1] == str(tmp_path)
