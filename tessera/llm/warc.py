"""WARC archives: a writer and a sequential reader.

``write`` makes gzip archives with one gzip member per record in a folder that all executors share; ``read``
goes through each archive once, front to back: incremental zlib decompression, record framing by
Content-Length, SHA-1 digests of block and payload checked on the way. Neither holds more than
one record; the reader holds no payload unless payloads are asked for.

Equal payloads of at least ``revisit_bytes`` bytes are stored once: the record with the largest
page_id is the response, the others are revisit records that refer to it. Equal means equal SHA-256.

Null html is an empty payload. Null url: no target header. Null page_id: no id header, so it reads back as
null, and it is a response only if no equal payload has an id (then all of them are). Rows repeated
with the largest page_id are responses each. Control characters of a url are percent-encoded.

Every task attempt writes files of its own; the manifest names only those of attempts that succeeded,
so a lost executor leaves nothing but files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, stored

#: An archive is closed when it has this many bytes.
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, digest_ok boolean")


def _filesystem(path: str):
    """(file system, path in it): local paths and file: URIs, else whatever store the URI names."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.FileSystem.from_uri(path)) if "://" in path else (fs.LocalFileSystem(), path)


# ---------------------------------------------------------------- writing

def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, size: int, sha1_hex: str, refers_to, date: str) -> Iterator[bytes]:
    """One record's bytes: header, then the block, in parts. A revisit (refers_to set) has no payload."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = hashlib.sha1(http)
    block.update(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {_record_id(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}",
             f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response",
             f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{base64.b32encode(block.digest()).decode()}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}",
                  f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(http) + len(payload)}")
    yield "\r\n".join(lines).encode() + b"\r\n\r\n" + http
    yield payload
    yield b"\r\n\r\n"


class _Archive:
    def __init__(self, folder: str, name: str):
        fs, at = _filesystem(folder)
        fs.create_dir(at, recursive=True)
        self.path = f"{folder}/{name}"
        self.out = fs.open_output_stream(f"{at}/{name}", compression=None)
        self.records = self.bytes = 0

    def add(self, parts: Iterator[bytes]) -> None:
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        for part in parts:
            self._put(member.compress(part))
        self._put(member.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> tuple:
        self.out.close()
        return self.path, self.records, self.bytes


def write(pages: DataFrame, folder: str | None = None, revisit_bytes: int = 0,
          date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of ``pages`` (page_id, url, html); returns the manifest (path, records, bytes).

    One shuffle, of rows by payload digest, unless the table of repeated digests is small enough for
    Spark to broadcast. The copies of a common page are pre-aggregated to one row; where they meet it
    again the join is a plain one that adaptive execution splits.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha256": F.sha2("payload", 256)})
    repeated = (rows.filter(F.col("size") >= revisit_bytes).groupBy("sha256")
                .agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
                .filter("copies > 1 and response is not null").select("sha256", "response"))
    rows = rows.join(repeated, "sha256", "left").withColumn(
        "refers_to", F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")))
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size",
                       F.sha1("payload").alias("sha1"), "refers_to")

    def run(batches):
        from pyspark import TaskContext
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        archive, number, done = None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if archive is None:
                    archive = _Archive(folder, f"{name}-{number:04d}.warc.gz")
                    number += 1
                archive.add(record(row["page_id"], row["url"], row["payload"] or b"", row["size"], row["sha1"],
                                   row["refers_to"], date))
                if archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    return stored(rows.mapInArrow(run, MANIFEST), "warc-manifest")


# ---------------------------------------------------------------- reading

class _Members:
    """The gzip members of a stream, decompressed piece by piece."""

    def __init__(self, stream):
        self.stream, self.ahead, self.member = stream, b"", None

    def open(self) -> bool:
        """Start the next member; False at the end of the stream."""
        if not self.ahead:
            self.ahead = self.stream.read(CHUNK)
        self.member = zlib.decompressobj(31)
        return bool(self.ahead)

    def parts(self) -> Iterator[bytes]:
        """The open member's bytes; raises if the archive ends inside it."""
        while not self.member.eof:
            data = self.member.unconsumed_tail or self.ahead or self.stream.read(CHUNK)
            if not data:
                raise ValueError("the archive ends inside a record")
            self.ahead = b""
            out = self.member.decompress(data, 1 << 20)
            if self.member.eof:
                self.ahead = self.member.unused_data
            if out:
                yield out


class _Record:
    """Buffered access to one member."""

    def __init__(self, parts: Iterator[bytes]):
        self._parts, self._held = parts, b""

    def until(self, mark: bytes) -> bytes:
        while mark not in self._held:
            more = next(self._parts, None)
            if more is None:
                raise ValueError("a record's header does not end")
            self._held += more
        head, self._held = self._held.split(mark, 1)
        return head

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self._held:
                self._held = next(self._parts, b"")
                if not self._held:
                    raise ValueError("a record is shorter than its Content-Length")
            part, self._held = self._held[:n], self._held[n:]
            n -= len(part)
            yield part

    def rest(self) -> bytes:
        return self._held + b"".join(self._parts)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_archive(stream, payload: bool = False) -> Iterator[dict]:
    """The records of one archive in order, each checked against its digests."""
    members = _Members(stream)
    while members.open():
        rec = _Record(members.parts())
        head = rec.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its WARC version")
        head = _fields(head)
        left = int(head["content-length"])
        block, body, size, kept, http, seen = hashlib.sha1(), hashlib.sha1(), 0, [], None, b""
        for part in rec.exactly(left):
            block.update(part)
            if http is None:
                seen += part
                if b"\r\n\r\n" not in seen:
                    continue
                http, part = seen.split(b"\r\n\r\n", 1)
                http = _fields(http)
            body.update(part)
            size += len(part)
            if payload:
                kept.append(part)
        if rec.rest() != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        response = head["warc-type"] == "response"
        b32 = lambda h: base64.b32encode(h.digest()).decode()
        declared = head["warc-payload-digest"].removeprefix("sha1:")
        ok = head["warc-block-digest"] == f"sha1:{b32(block)}"
        number = lambda k: int(head[k]) if k in head else None
        yield {"page_id": number("x-page-id"), "url": head.get("warc-target-uri"),
               "payload_bytes": size if response else int(http["content-length"]),
               "payload_digest": b32(body) if response else declared, "record_type": head["warc-type"],
               "refers_to": number("x-refers-to-page-id"),
               "digest_ok": ok and (not response or (b32(body) == declared and size == int(http["content-length"])))
               } | ({"payload": b"".join(kept) if response else None} if payload else {})


def read(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives that ``manifest`` (column path) names; with ``payload``, their bytes too.

    A record whose digests do not hold has digest_ok false; an archive with broken framing raises. Archives are dealt
    round robin to two tasks for each core of the session, which adaptive execution keeps apart.
    """
    schema = RECORD + (", payload binary" if payload else "")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _filesystem(path)
                held, size = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for row in read_archive(stream, payload):
                        held.append(row)
                        size += len(row.get("payload") or b"") + 200
                        if size > 4 << 20:
                            yield _batch(held, names)
                            held, size = [], 0
                if held:
                    yield _batch(held, names)

    tasks = 2 * manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("path").repartition(tasks).mapInArrow(run, schema)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "digest_ok": pa.bool_(),
             "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)


def op5(spark, sf_dir: str) -> DataFrame:
    """op5: all pages written to archives, the archives read back, every digest checked."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = read(write(pages.select("page_id", "url", "html")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


#: The same result without archives: SHA-1 in base32 digit by digit, the largest id of equal payloads.
OP5_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, html, sha1(html) as hex, max(page_id) over (partition by html) as top from p)
select page_id, strlen(html)::bigint as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, (5 * (i // 4) + 1)::integer, 5))::integer >> (15 - 5 * (i % 4))::integer) & 31) + 1, 1)), '')
         as payload_digest,
       case when page_id = top then 'response' else 'revisit' end as record_type,
       case when page_id <> top then top end as refers_to, true as digest_ok
from h
"""
