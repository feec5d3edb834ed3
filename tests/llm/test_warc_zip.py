import base64
import gzip
import hashlib
import io
import json
import zipfile

import pytest

from tesselum.llm import warc_zip as w


def test_round_trip_with_revisits_nulls_and_small_packages(spark, tmp_path):
    big, small = "é" * 700, "x" * 999
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (None, "n", big), (2, "http://a/2", big), (7, "u", "z" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS payload")
    folder = f"file://{tmp_path}/w"
    got = w.read(w.write(df, folder, package=600), folder).collect()
    assert len(got) == len(rows)
    for r in got:
        same = [b for i, _, b in rows if (str(i) if i is not None else None) == r["id"]]
        text = (same[0] or "").encode()
        assert (r["payload_bytes"], r["digest"]) == (len(text), hashlib.sha1(text).hexdigest())
        if r["id"] in ("1", "2"):
            assert (r["type"], r["refers_to"], r["payload"]) == ("revisit", "9", None)
        else:
            assert (r["type"], r["refers_to"], bytes(r["payload"])) == ("response", None, text)
    assert {r["target"] for r in got if r["id"] == "9"} == {None}


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    assert w.read(w.write(df, folder), folder).collect() == []


@pytest.mark.parametrize("force", [False, True])
def test_directory_reads_what_zipfile_writes(force):
    data = {"a/x.bin": b"abc" * 100, "b.txt": b"", "ünï": b"PK\5\6" * 9}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in data.items():
            with z.open(name, "w", force_zip64=force) as f:
                f.write(content)
        z.comment = b"PK\5\6 not the end"
    raw = out.getvalue()
    members = w.directory(io.BytesIO(raw), len(raw))
    assert {m.name: raw[(at := w.stored_at(io.BytesIO(raw), m)) : at + m.size] for m in members} == data


def test_zip64_end_record():
    """A directory that is only described by the ZIP64 end record and extra fields."""
    import struct

    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, 3, 3, 1, 0) + b"n" + b"abc"
    extra = struct.pack("<HHQQQ", 1, 24, 3, 3, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"n" + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, len(local) + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + central + end64 + locator + end
    (m,) = w.directory(io.BytesIO(raw), len(raw))
    at = w.stored_at(io.BytesIO(raw), m)
    assert (m.name, raw[at : at + m.size]) == ("n", b"abc")


def test_damaged_files_are_refused():
    with pytest.raises(ValueError, match="no end of central"):
        w.directory(io.BytesIO(b"abc"), 3)


def test_query_matches_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = c.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({w.ORACLE})").fetchall()
    got = w.op1_warc_zip(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def _record(kind, uri, block, digest=None, **more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uri or kind}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {uri}"] * bool(uri) + [f"WARC-Payload-Digest: {digest}"] * bool(digest) + [f"{k}: {v}" for k, v in more.items()]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _http(body):
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Length: %d\r\n\r\n" % len(body) + body


def _records():
    a, b = b"first page" * 300, b"second"
    sha = lambda x: hashlib.sha1(x).digest()
    return [
        _record("warcinfo", None, b"software: other\r\n"),
        _record("request", "http://a/", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        _record("response", "http://a/", _http(a), "sha1:" + base64.b32encode(sha(a)).decode()),
        _record("response", "http://b/", _http(b), "sha1:" + sha(b).hex()),
        _record("response", "http://c/", _http(b"")),
        _record("revisit", "http://d/", b"HTTP/1.1 200 OK\r\n\r\n", "sha1:" + base64.b32encode(sha(a)).decode(), **{"WARC-Refers-To": "<urn:uuid:http://a/>"}),
        _record("resource", "urn:x", b"a: b\r\n\r\nblock"),
    ]


def _foreign(path, index):
    """A package as another program lays it out: several archives, one of them plain and one without index, other members compressed."""
    records = _records()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("datapackage.json", "{}" * 500, zipfile.ZIP_DEFLATED)
        at, lines = 0, []
        packed = [gzip.compress(r) for r in records]
        for r, raw in zip(packed, records, strict=True):
            lines.append((raw.split(b"Target-URI: ")[-1].split(b"\r")[0].decode() if b"Target-URI" in raw else "-", at, len(r), "rec-00000-0001.warc.gz"))
            at += len(r)
        z.writestr("archive/rec-00000-0001.warc.gz", b"".join(packed), zipfile.ZIP_STORED)
        z.writestr("archive/rec-2.warc", b"".join(records), zipfile.ZIP_STORED)
        at = 0
        for raw in records:
            lines.append(("two", at, len(raw), "rec-2.warc"))
            at += len(raw)
        z.writestr("archive/more.warc.gz", b"".join(packed), zipfile.ZIP_STORED)
        z.writestr("archive/more.warc", b"".join(records), zipfile.ZIP_STORED)
        lines.sort(reverse=True)
        cdxj = "!meta {}\n" + "".join(f"{u} 20200101000000 {json.dumps({'url': u, 'offset': str(o), 'length': n, 'filename': f})}\n" for u, o, n, f in lines)
        cdx = " CDX N b a m s k r M S V g\n" + "".join(f"{u} 2020 {u} text/html 200 X - - {n} {o} {f}\n" for u, o, n, f in lines)
        if index == "cdxj":
            z.writestr("indexes/index.cdxj", cdxj, zipfile.ZIP_STORED)
            z.writestr("indexes/old.cdx", cdx, zipfile.ZIP_STORED)
        elif index == "cdx":
            z.writestr("indexes/index.cdx", cdx, zipfile.ZIP_STORED)
        elif index == "gz":
            z.writestr("indexes/index.cdx.gz", gzip.compress(cdxj[: len(cdxj) // 2].encode()) + gzip.compress(cdxj[len(cdxj) // 2 :].encode()), zipfile.ZIP_STORED)
        z.comment = b"made elsewhere"


@pytest.mark.parametrize("index", ["cdxj", "cdx", "gz", "none"])
def test_packages_of_other_programs(spark, tmp_path, index, monkeypatch):
    _foreign(f"{tmp_path}/p.wacz", index)
    folder = f"file://{tmp_path}"
    packages = spark.createDataFrame([(f"{tmp_path}/p.wacz",)], "path string")
    for size in (w.RANGE, 100):
        dealt = w.ranges(packages, folder, size).collect()
        assert sum(len(r["lengths"]) for r in dealt) == 28
    got = w.read(packages, folder).collect()
    sha = lambda x: hashlib.sha1(x).hexdigest()
    a = b"first page" * 300
    want = [
        ("warcinfo", None, b"software: other\r\n", None), ("request", "http://a/", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", None), ("response", "http://a/", a, None),
        ("response", "http://b/", b"second", None), ("response", "http://c/", b"", None), ("revisit", "http://d/", None, "<urn:uuid:http://a/"), ("resource", "urn:x", b"a: b\r\n\r\nblock", None),
    ]
    want = sorted(((k, t, sha(a if p is None else p), None if p is None else len(p)) for k, t, p, _ in want for _ in range(4)), key=str)
    assert sorted(((r["type"], r["target"], r["digest"], r["payload_bytes"]) for r in got), key=str) == want
    assert all(r["payload"] is None or sha(r["payload"]) == r["digest"] for r in got)


def test_what_cannot_be_read_is_refused(tmp_path):
    def package(method=zipfile.ZIP_STORED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("archive/data.warc.gz", gzip.compress(_records()[2]), method)
        return bytearray(out.getvalue())

    raw = package()
    at = raw.rindex(b"PK\1\2")
    raw[at + 8] |= 1
    (m,) = w.directory(io.BytesIO(raw), len(raw))
    with pytest.raises(ValueError, match="encrypted"):
        w.stored_at(io.BytesIO(raw), m)
    raw = package()
    raw[raw.rindex(b"PK\5\6") + 4] = 1
    with pytest.raises(ValueError, match="several parts"):
        w.directory(io.BytesIO(raw), len(raw))
    raw = package(zipfile.ZIP_DEFLATED)
    (m,) = w.directory(io.BytesIO(raw), len(raw))
    with pytest.raises(ValueError, match="compressed"):
        w.stored_at(io.BytesIO(raw), m)


def test_many_revisits_are_joined(spark, tmp_path, monkeypatch):
    rows = [(i, "u", f"{i % 3}" * 2000) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for k, most in enumerate((w.BROADCAST, 0)):
        monkeypatch.setattr(w, "BROADCAST", most)
        folder = f"file://{tmp_path}/{k}"
        found.append(sorted(map(tuple, w.read(w.write(df, folder), folder, payloads=False).collect())))
    assert found[0] == found[1] and sum(r[2] == "revisit" for r in found[0]) == 27
