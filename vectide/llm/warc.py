"""WARC archives as a chunked record table.

Writing: pages become gzip-member WARC records in archive files of the shared folder.
Reading: each archive is streamed in small blocks; a record's payload comes out as
rows (record_id, chunk_no, ...) with a digest carried from chunk to chunk, so no task
holds more than one chunk of any payload.

Revisit rule: of records with equal payloads of at least min_revisit bytes, the one
with the smallest id is stored as a response; the others become revisit records that
refer to it and carry no payload. Smaller payloads are always responses.

Defined results for odd input: a null payload is the empty payload, a null url gives a
record without a target, control characters in a url are percent-encoded, rows that
repeat an id and payload are responses each, an empty table gives no archives and no
rows, further columns are ignored. Ids must be integers and not null.

Recovery: a task writes to a file name of its own attempt and reports it only at its
end; only reported files are read, so lost or repeated tasks leave no double records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import materialize, shared_dir, tidy

_URN = "urn:vectide:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GONE = str.maketrans({**{i: f"%{i:02X}" for i in range(33)}, 127: "%7F"})


def record_header(record_id: int, url: str | None, date: str, digest: str, size: int, refers_to: int | None) -> bytes:
    """The WARC and HTTP header lines of one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url.translate(_GONE)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    block = len(http) + (size if refers_to is None else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode("utf-8")


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit: int = 100, date: str = "2024-01-01T00:00:00Z", chunk: int = 1 << 18, level: int = 1) -> DataFrame:
    """Write one record per row; returns the archives written as (path, records, bytes)."""
    spark = pages.sparkSession
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    digest = F.sha2("body", 256)
    keys = materialize(rows.select("id", digest.alias("digest"), F.octet_length("body").cast("long").alias("size")), "warc-keys")
    first = keys.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1")
    again = keys.join(first.select("digest", "first"), "digest").where("id <> first").select("id", "digest", "first").distinct()
    planned = rows.withColumn("digest", digest).join(again, ["id", "digest"], "left").select("id", "url", "body", "digest", F.col("first").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        path = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, records, size = None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                rid, url, payload, digest_, refers = (batch.column(c)[i] for c in range(5))
                view = memoryview(payload.as_buffer())
                out = out or store.open_output_stream(path)
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                parts = [member.compress(record_header(rid.as_py(), url.as_py(), date, digest_.as_py(), len(view), refers.as_py()))]
                if not refers.is_valid:
                    for at in range(0, len(view), chunk):
                        parts.append(member.compress(view[at : at + chunk]))
                        if sum(map(len, parts)) >= chunk:
                            out.write(b"".join(parts))
                            size += sum(map(len, parts))
                            parts = []
                parts += [member.compress(b"\r\n\r\n"), member.flush()]
                out.write(b"".join(parts))
                size += sum(map(len, parts))
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    return materialize(planned.mapInArrow(tidy(write), "path string, records long, bytes long"), "warc-manifest")


class _Stream:
    """Decompressed bytes of a multi-member gzip file, read in blocks."""

    def __init__(self, source, block: int):
        self.source, self.block, self.buf = source, block, bytearray()
        self.member, self.raw = zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Add some decompressed bytes to buf; False at the end of the file."""
        while True:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(self.block)
                if not self.raw:
                    return False
            got = self.member.decompress(self.raw, self.block)
            self.raw = self.member.unconsumed_tail
            if got:
                self.buf += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Take everything up to and with mark; None at the end of the file."""
        seen = 0
        while (at := self.buf.find(mark, seen)) < 0:
            seen = max(0, len(self.buf) - len(mark) + 1)
            if not self.more():
                if self.buf:
                    raise ValueError("archive ends inside a record")
                return None
        head = bytes(self.buf[: at + len(mark)])
        del self.buf[: at + len(mark)]
        return head

    def take(self, n: int) -> bytes:
        """Take n bytes."""
        while len(self.buf) < n:
            if not self.more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}


def read_stream(source, chunk: int) -> Iterator[tuple]:
    """Rows (record_id, chunk_no, last, type, refers_to, url, bytes_so_far, digest_so_far, data)."""
    s = _Stream(source, 1 << 16)
    page = lambda urn: int(urn.strip("<>")[len(_URN) :])
    while (head := s.until(b"\r\n\r\n")) is not None:
        f = _fields(head)
        left, kind = int(f["content-length"]), f["warc-type"]
        http = s.until(b"\r\n\r\n")
        left -= len(http)
        rid, url = page(f["warc-record-id"]), f.get("warc-target-uri")
        if kind == "revisit":
            s.take(left)
            yield rid, 0, True, kind, page(f["warc-refers-to"]), url, int(_fields(http)["content-length"]), f["warc-payload-digest"].partition(":")[2], b""
        else:
            digest, done, no = hashlib.sha256(), 0, 0
            while True:
                data = s.take(min(chunk, left))
                left -= len(data)
                done += len(data)
                digest.update(data)
                yield rid, no, left == 0, kind, None, url, done, digest.copy().hexdigest(), data
                no += 1
                if not left:
                    break
            if digest.hexdigest() != f["warc-payload-digest"].partition(":")[2]:
                raise ValueError(f"record {rid}: the payload does not match its digest")
        if s.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {rid} has no end mark")


_NAMES = ["record_id", "chunk_no", "last", "record_type", "refers_to", "url", "bytes_so_far", "digest_so_far", "data"]
_CHUNKS = pa.schema([("record_id", pa.int64()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("data", pa.binary())])


def read_archives(manifest: DataFrame, folder: str, chunk: int = 1 << 18, with_data: bool = True) -> DataFrame:
    """The chunked record table of all archives in the manifest.

    One row per chunk; bytes_so_far and digest_so_far cover the payload up to and with
    the chunk. A response of no bytes has one empty chunk; a revisit has one row with
    the size and digest of the payload it refers to. with_data=False leaves the bytes
    out and returns each record's last row alone.
    """
    spark = manifest.sparkSession
    paths = manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism * 2))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(folder)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path) as source:
                    for row in read_stream(source, chunk):
                        if not with_data:
                            if not row[2]:
                                continue
                            row = (*row[:8], None)
                        rows.append(row)
                        held += 200 + len(row[8] or b"")
                        if held >= 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CHUNKS.types)], schema=_CHUNKS)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CHUNKS.types)], schema=_CHUNKS)

    return paths.mapInArrow(tidy(read), "record_id long, chunk_no long, last boolean, record_type string, refers_to long, url string, bytes_so_far long, digest_so_far string, data binary")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages to archives, read them back, return each record's totals."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    last = read_archives(manifest, folder, with_data=False).where("last")
    return last.select(F.col("record_id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND f <> page_id THEN f END AS refers_to
FROM g
"""
