"""WARC archives and their chunked record table.

Writing: equal payloads of some size become one response and revisit records that refer to it. A payload reaches the
writer as chunks and streams into one gzip member per record. Reading: an archive streams through a fixed buffer into
rows (record id, chunk number, chunk, digest so far), so neither side ever holds a whole record in Python. A header is
held whole, however long its url. Records of other writers and kinds are read as well, compressed or not.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, new_path, stored

#: Bytes of a chunk; compressed bytes after which a new archive begins; bytes read at a time; bytes of archives a reading task.
CHUNK, ARCHIVE, BUFFER, TASK = 1 << 20, 64 << 20, 1 << 18, 1 << 30
#: Payloads from this size on are revisited.
LEAST_REVISITED = 1000
RECORD = "urn:x-tidewater:page:"
CHUNK_SCHEMA = "archive string, record_id string, page_id long, record_type string, target_uri string, refers_to string, chunk_no int, chunk binary, bytes_so_far long, sha1_so_far string, last boolean, declared_bytes long, declared_sha1 string"


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<{RECORD}{'' if page_id is None else page_id}:{sha1[:16]}>"


def page_of(urn: str | None) -> int | None:
    """The id in a record name of write_archives(); null for other names."""
    found = re.fullmatch(rf"<{RECORD}(-?\d+):[0-9a-f]{{16}}>", urn or "")
    return int(found[1]) if found else None


def labelled(sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()


def _head(page_id, url, kind, keep, size, sha1, date) -> bytes:
    """The WARC header and, for responses, the HTTP header that is part of the block."""
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", "", ""]
    http = "\r\n".join(lines).encode()
    block = len(http) + (size if kind == "response" else 0)
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~", errors="replace") if url else f"{RECORD}{'' if page_id is None else page_id}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, sha1)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: {labelled(sha1)}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(keep, sha1)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {block}", "", ""]
    return "\r\n".join(head).encode() + http


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row; returns (archive, records, bytes) of the archives, in the shared folder.

    Null payloads are empty, null urls get a urn, control characters and blanks in urls are escaped. Of payloads equal
    in SHA-1 and length, of at least 1000 bytes, rows with the largest id are responses (all of them, if the row is
    repeated) and the others revisits; rows without an id revisit as well, unless none has one. Only archives of tasks
    that ended are listed: a repeated task writes files of its own. Other columns are ignored. An empty table gives no
    archive and an empty manifest.
    """
    spark = pages.sparkSession
    base = new_path(spark, "warc")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    large = p.where(F.col("size") >= LEAST_REVISITED)
    # Only payloads that occur more than once: a table Spark can size up, to broadcast it or not.
    several = stored(large.groupBy("sha1", "size").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null").drop("n"), "several")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    p = p.join(several, ["sha1", "size"], "left").withColumn("kind", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")))
    # chunk numbers first, chunks after them: the payload is there once, and beside it one chunk at a time
    last = F.when(F.col("kind") == "response", F.greatest(F.ceil(F.col("size") / CHUNK).cast("int") - 1, F.lit(0))).otherwise(F.lit(0))
    rows = p.select("page_id", "url", "kind", "keep", "size", "sha1", "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    chunk = F.when(F.col("kind") == "response", F.substring("payload", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))).otherwise(F.lit(b""))
    rows = rows.select("page_id", "url", "kind", "keep", "size", "sha1", "chunk_no", chunk.alias("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        out = archive = pack = None
        records = written = left = 0

        def put(data: bytes) -> None:
            nonlocal written
            written += len(data)
            out.write(data)

        def listed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [archive], "records": pa.array([records], pa.int64()), "bytes": pa.array([written], pa.int64())})

        for b in batches:
            for page_id, url, kind, keep, size, sha1, chunk_no, chunk in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk_no == 0:
                    if out is not None and written >= ARCHIVE:
                        yield listed()
                        out = None
                    if out is None:
                        name, records, written = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        archive, out = f"{base}/{name}", store.open_output_stream(f"{root}/{name}", compression=None)
                    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                    put(pack.compress(_head(page_id, url, kind, keep, size, sha1, date)))
                    records, left = records + 1, size if kind == "response" else 0
                put(pack.compress(chunk))
                left -= len(chunk)
                if left <= 0:
                    put(pack.compress(b"\r\n\r\n") + pack.flush())
        if out is not None:
            yield listed()

    manifest = stored(rows.mapInArrow(run, "archive string, records long, bytes long"), "manifest")
    dropped(several)
    return manifest


class _Stream:
    """Bytes of an archive as they are asked for, decompressed member by member if they are compressed."""

    def __init__(self, raw):
        self.raw, self.held, self.more, self.ended = raw, bytearray(), zlib.decompressobj(31), False
        self.first = raw.read(BUFFER)
        self.plain = not self.first.startswith(b"\x1f\x8b")

    def _read(self) -> bytes:
        out, self.first = self.first or self.raw.read(BUFFER), b""
        return out

    def fill(self) -> bool:
        while not self.ended:
            if self.plain:
                got = self._read()
                self.ended = not got
            else:
                data = self.more.unconsumed_tail or (self.more.unused_data if self.more.eof else b"") or self._read()
                if self.more.eof:
                    self.more = zlib.decompressobj(31)
                if not data:
                    self.ended = True
                    break
                got = self.more.decompress(data, BUFFER)
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the archive."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.fill():
                if self.held:
                    raise ValueError("archive cut off")
                return None
        return self.take(at + len(mark))

    def begins(self, mark: bytes) -> bool:
        while len(self.held) < len(mark) and self.fill():
            pass
        return self.held.startswith(mark)

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.fill():
                raise ValueError("archive cut off")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(header: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in header.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def declared_sha1(label: str | None) -> str | None:
    """A header's SHA-1 as hex, from base 32 or hex; null for none and for other digests."""
    kind, _, value = (label or "").partition(":")
    try:
        if kind.lower().replace("-", "") == "sha1":
            return bytes.fromhex(value).hex() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except (ValueError, binascii.Error):
        pass
    return None


def records_of(raw, archive: str) -> Iterator[tuple]:
    """Rows of the chunked record table, in the order of the archive."""
    stream = _Stream(raw)
    while (header := stream.until(b"\r\n\r\n")) is not None:
        f = _fields(header)
        left, kind = int(f["content-length"]), f.get("warc-type", "")
        # an HTTP message's payload comes after its own header; any other block is payload
        if f.get("content-type", "").lower().startswith("application/http") and left and stream.begins(b"HTTP/"):
            left -= len(stream.until(b"\r\n\r\n"))
            if left < 0:
                raise ValueError(f"{archive}: an HTTP header is longer than its record")
        digest, so_far, chunk_no = hashlib.sha1(), 0, 0
        declared, name = declared_sha1(f.get("warc-payload-digest")), f.get("warc-record-id", "")
        size = int(f["x-payload-length"]) if "x-payload-length" in f else None if kind == "revisit" else left
        while True:
            chunk = stream.take(min(CHUNK, left - so_far))
            digest.update(chunk)
            so_far += len(chunk)
            last = so_far == left
            yield (archive, name, page_of(name), kind, f.get("warc-target-uri"), f.get("warc-refers-to"), chunk_no, chunk, so_far, digest.hexdigest(), last, size, declared)
            if last:
                break
            chunk_no += 1
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"{archive}: a record does not end where its length says")
        if kind == "response" and declared and digest.hexdigest() != declared:
            raise ValueError(f"{archive}: payload digest differs in {name}")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The chunked record table of the archives listed in `archive`: one row per chunk, in CHUNK_SCHEMA.

    Each archive is a stream in one task; a task has archives of about TASK bytes. A record's length and end are checked
    against its header, and so is a response's digest if it is a SHA-1. Records that write_archives() did not write have
    a null page_id; what their headers lack (digest, length of a revisited payload, names) is null or empty. No archive
    gives no rows.
    """
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        for b in batches:
            for archive in b.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_stream(path, compression=None) as raw:
                    rows, size = [], 0
                    for row in records_of(raw, archive):
                        rows.append(row)
                        size += len(row[7])
                        if size >= 8 * CHUNK or len(rows) >= 5000:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    found = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(found[0], max(4 * manifest.sparkSession.sparkContext.defaultParallelism, -(-found[1] // TASK))))
    return manifest.select("archive").repartition(tasks).mapInArrow(run, CHUNK_SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    response = F.col("record_type") == "response"
    refers = F.regexp_extract("refers_to", RECORD + r"(-?\d*):", 1)
    return chunks.where("last").select(
        "page_id",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("sha1_so_far")).otherwise(F.col("declared_sha1")).alias("payload_digest"),
        "record_type",
        F.when(~response, refers.cast("long")).alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM p),
t AS (SELECT *, payload_bytes >= 1000 AND keep IS NOT NULL AND page_id IS DISTINCT FROM keep AS revisit FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN keep END AS refers_to FROM t
"""
