"""WARC archives: one gzip member a record, written by each task, read back sequentially with every frame verified."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_PAYLOAD = 0
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
_PIECE, _HEAD = 1 << 20, 1 << 20
#: Payloads that repeat are broadcast by digest up to so many (40 bytes each), else joined.
BROADCAST = 200_000
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def sha1_32(data: bytes) -> str:
    return _base32(hashlib.sha1(data))


def _urn(page: int | None) -> bytes:
    return b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}")).encode()


def record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of page `first`, whose block is the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _urn(page), b"WARC-Date: " + date.encode()]
    if page is not None:
        head.append(b"WARC-Page-ID: %d" % page)
    if url:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    if revisit:
        head += [b"WARC-Profile: " + _PROFILE, b"WARC-Refers-To: " + _urn(first), b"WARC-Refers-To-Page-ID: %d" % first]
    head += [b"WARC-Payload-Digest: sha1:" + sha1_32(payload).encode(), b"WARC-Block-Digest: sha1:" + sha1_32(block).encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}


class _Record:
    """A record that is read piece by piece: its head, then a block of content-length bytes, then the closing lines."""

    def __init__(self, keep: bool):
        self.keep, self.fields, self.left, self.held = keep, None, 0, b""
        self.block, self.payload, self.parts, self.size, self.http = hashlib.sha1(), hashlib.sha1(), [], 0, None

    def add(self, data: bytes) -> None:
        if self.fields is None:
            self.held += data
            head, gap, data = self.held.partition(b"\r\n\r\n")
            lines = head.split(b"\r\n")
            if not b"WARC/1.1\r\n".startswith(self.held[:10]) or len(self.held) > _HEAD and not gap:
                raise ValueError("no WARC record")
            if not gap:
                return
            self.fields, self.held = _fields(lines[1:]), b""
            self.left = int(self.fields["content-length"])
        block, self.held = data[: self.left], self.held + data[self.left :]
        self.left -= len(block)
        if len(self.held) > 4:
            raise self.fault("the content length doesn't frame the record")
        self.block.update(block)
        if isinstance(self.http, dict):
            self._body(block)
        elif block:
            head, gap, rest = ((self.http or b"") + block).partition(b"\r\n\r\n")
            self.http = _fields(head.split(b"\r\n")[1:]) if gap else head
            if gap:
                self._body(rest)

    def _body(self, data: bytes) -> None:
        self.size += len(data)
        self.payload.update(data)
        if self.keep:
            self.parts.append(data)

    def fault(self, what: str) -> ValueError:
        return ValueError(f"{(self.fields or {}).get('warc-record-id', 'a record')}: {what}")

    def end(self) -> dict:
        """The record's fields, once its frame, lengths and digests are verified."""
        f = self.fields
        if f is None:
            raise ValueError("no WARC record")
        if self.left or self.held != b"\r\n\r\n":
            raise self.fault("the content length doesn't frame the record")
        if f["warc-block-digest"] != f"sha1:{_base32(self.block)}":
            raise self.fault("wrong block digest")
        if not isinstance(self.http, dict):
            raise self.fault("no HTTP head")
        size, kind, digest = int(self.http["content-length"]), f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (self.size != size or _base32(self.payload) != digest):
            raise self.fault("wrong payload")
        page, to = f.get("warc-page-id"), f.get("warc-refers-to-page-id")
        payload = b"".join(self.parts) if self.keep and kind == "response" else None
        return {"page_id": page and int(page), "url": f.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": to and int(to), "payload": payload}


def read_records(stream: BinaryIO, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive, one gzip member each, framed and verified while they are decompressed piece by piece.

    However long a record is, a piece of it is in memory, or its payload if that is asked for.
    """
    rest = b""
    while True:
        rest = rest or stream.read(_PIECE)
        if not rest:
            return
        z, record = zlib.decompressobj(wbits=31), _Record(payloads)
        while not z.eof:
            rest = rest or stream.read(_PIECE)
            got = z.decompress(rest, _PIECE)
            if not (rest or got or z.eof):
                raise ValueError("the archive ends within a record")
            record.add(got)
            rest = z.unused_data if z.eof else z.unconsumed_tail
        yield record.end()


def mark_revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, html -> the same and first_id: the smallest page_id of the rows with equal payload, null where it is no revisit.

    Payloads are equal if their SHA-256 is. Ids and digests are aggregated before the shuffle, and only digests that
    repeat go on. Up to BROADCAST of them are broadcast, so no html is shuffled; with more, pages meet them by digest,
    where a payload that a third of the rows share is a skewed join, which adaptive execution splits.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    source = source.withColumn("key", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    firsts = common.cut(source.where(F.octet_length("html") >= min_payload).groupBy("key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("key", "first_id"))
    found = source.join(F.broadcast(firsts) if firsts.count() <= BROADCAST else firsts, "key", "left")
    return found.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("first_id"))


def write_warc(pages: DataFrame, folder: str, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, url, html -> .warc.gz files below folder (a URI that executors can write); returns path, records, bytes.

    Null html is an empty payload; null page_id and url are left out of the record. Repeated rows of the page that is
    the response are responses themselves. File names hold the attempt, and only files that a successful task
    reports count, so a lost executor's half-written files are never read.
    """
    common.small_batches(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at, out, path, n, size, part = TaskContext.get(), None, "", 0, 0, 0
        store, root = fs.FileSystem.from_uri(folder)
        done: list[tuple[str, int, int]] = []
        for b in batches:
            for page, url, html, first in zip(*(b.column(k) for k in range(4)), strict=True):
                if out is None:
                    name = f"part-{at.partitionId():06d}-{at.taskAttemptId()}-{part:04d}.warc.gz"
                    store.create_dir(root, recursive=True)
                    out, path, n, size, part = store.open_output_stream(f"{root}/{name}", compression=None), name, 0, 0, part + 1
                to = first.as_py()
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(record(page.as_py(), url.as_py(), html.as_py().encode(), to, to is not None, date)) + z.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done, out = [*done, (path, n, size)], None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p, _, _ in done]), pa.array([n for _, n, _ in done], pa.int64()), pa.array([s for _, _, s in done], pa.int64())], ["path", "records", "bytes"])

    return common.cut(mark_revisits(pages).mapInArrow(work, "path string, records long, bytes long"))


def read_warc(files: DataFrame, payloads: bool = False) -> DataFrame:
    """path -> page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload.

    Each file is read by a task of its own from its start to its end, a piece of a record in memory at a time. No file
    gives no rows; a damaged one fails. files must be kept (one short row a file is counted first).
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                held: list[dict] = []
                size = 0
                with store.open_input_stream(path, compression=None) as stream:
                    for got in read_records(stream, payloads):
                        held.append(got)
                        size += len(got["payload"] or b"") + 1000
                        if size > common.BATCH_BYTES:
                            yield _batch(held, names, kinds)
                            held, size = [], 0
                if held:
                    yield _batch(held, names, kinds)

    # A file's number is its partition: as many tasks as files.
    numbered = files.select("path").withColumn("k", (F.row_number().over(Window.orderBy("path")) - 1).cast("int"))
    one = numbered.repartitionById(max(1, files.count()), "k").select("path")
    return one.mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def _batch(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    files = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    read = common.cut(read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    common.remove(spark, folder)
    return read


ORACLE = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(p.h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
}
QUERIES = {"op7_warc": op7_warc}
