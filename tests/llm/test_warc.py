import gzip
import hashlib

import pytest
from pyarrow import fs

from tidewater.llm import warc

BIG = "ü" * 600


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        revisit = len(data) >= 1000 and same and page != max(same)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/x y", BIG), (5, None, BIG), (3, "http://b/", BIG), (7, "", None), (8, "http://c/\r\nX: y", ""), (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "http://d", "\r\n\r\nWARC/1.0\r\n\r\n" * 80), (5, None, BIG), (None, "u", BIG), (12, "u", "ab" * 3_000_000)]


def test_round_trip(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    manifest = warc.write_archives(df)
    chunks = warc.read_archives(manifest)
    last = chunks.where("last").collect()
    got = sorted(((r.page_id, r.bytes_so_far if r.record_type == "response" else r.declared_bytes, r.sha1_so_far if r.record_type == "response" else r.declared_sha1, r.record_type, warc.page_of(r.refers_to)) for r in last), key=str)
    assert got == expected(ROWS)
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    # the chunks of a record make up its payload
    parts = sorted((r.chunk_no, bytes(r.chunk)) for r in chunks.where("page_id = 12").collect())
    assert len(parts) == 6 and max(len(p[1]) for p in parts) <= warc.CHUNK
    assert b"".join(p[1] for p in parts).decode() == "ab" * 3_000_000


def test_archive_is_plain_warc(spark):
    path = warc.write_archives(spark.createDataFrame([(1, "http://a/", "hello")], "page_id long, url string, html string")).first()["archive"]
    store, at = fs.FileSystem.from_uri(path)
    text = gzip.decompress(store.open_input_stream(at, compression=None).readall()).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("\r\n\r\nhello\r\n\r\n")
    assert "WARC-Target-URI: http://a/\r\n" in text


def test_empty_table_and_clashing_columns(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    df = spark.createDataFrame([(1, "u", "x", 3, "s", "k")], "page_id long, url string, html string, size long, sha1 string, kind string")
    assert warc.read_archives(warc.write_archives(df)).count() == 1


def test_archives_roll(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 200)
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    m = warc.write_archives(df)
    assert m.count() > 3 and warc.read_archives(m).select("page_id").distinct().count() == 20


def test_very_long_url(spark):
    rows = [(1, "http://a/" + "é b" * 100_000, "one"), (2, "http://b/", "two")]
    out = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((r.page_id, bytes(r.chunk)) for r in out) == [(1, b"one"), (2, b"two")]
    assert len(next(r.target_uri for r in out if r.page_id == 1)) == 9 + 100_000 * len("%C3%A9%20b")


def foreign():
    def record(fields, block):
        return ("\r\n".join(["WARC/1.0", *fields, f"Content-Length: {len(block)}", "", ""])).encode() + block + b"\r\n\r\n"

    http, body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n", b"<p>hi</p>" * 200
    return [
        record(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: other\r\n"),
        record(["WARC-Type: request", "WARC-Record-ID: <urn:uuid:2>", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        record(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:3>", "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + hashlib.sha1(body).hexdigest()], http + body),
        record(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:4>", "Content-Type: text/dns", "WARC-Payload-Digest: md5:00"], b"dns answer"),
        record(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:5>", "Content-Type: application/http; msgtype=response", "WARC-Refers-To: <urn:uuid:3>"], http),
        record(["WARC-Type: resource", "WARC-Record-ID: <urn:uuid:6>"], b""),
    ], body


@pytest.mark.parametrize("compressed", [True, False])
def test_records_of_other_writers(spark, tmp_path, compressed):
    records, body = foreign()
    (tmp_path / "a.warc").write_bytes(b"".join(gzip.compress(r) for r in records) if compressed else b"".join(records))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc", 1)], "archive string, bytes long")
    got = {r.record_id: r for r in warc.read_archives(manifest).collect()}
    assert [bytes(got[f"<urn:uuid:{i}>"].chunk) for i in range(1, 7)] == [b"software: other\r\n", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", body, b"dns answer", b"", b""]
    assert all(r.page_id is None and r.last for r in got.values())
    assert got["<urn:uuid:3>"].declared_sha1 == got["<urn:uuid:3>"].sha1_so_far and got["<urn:uuid:4>"].declared_sha1 is None and got["<urn:uuid:5>"].declared_bytes is None
