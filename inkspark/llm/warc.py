"""WARC archives with revisit records, written and read back sequentially (operator 4).

Writing: a record for each page, one gzip member per record, one archive per task. Of pages with equal payloads (html
in UTF-8, null as empty) of at least ``min_bytes`` bytes, the one with the largest id is a response; the others are
revisits without payload that refer to it. Repeated rows with one id give one response and revisits of it. Ids are integers
or strings of digits; a null id is the smallest.

Files carry names of their own for each task attempt, and a manifest table written by Spark lists those of the
attempts that counted; so lost executors leave no half archive behind that a reader would see.

Reading: each archive is streamed in blocks, its members decompressed piece by piece, records framed by their
Content-Length, and block and payload digests verified. Memory is bounded by a block, whatever a record's size,
unless payloads are asked for. A wrong digest, length or a cut file raises ValueError with the archive's name.

Repeated rows each give a record, an empty table no archive and no rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import has_rows, join_checked, materialize, scratch

_BLOCK = 1 << 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def decide(pages: DataFrame, min_bytes: int = 0, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, record_type and refers_to; one row for each page. Groups are counted from digests and ids alone;
    a payload travels only where the groups of two or more are too many to broadcast, or where rows with one id and payload
    must be told apart."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.sha2("payload", 256)).otherwise(""))
    groups = rows.where("key <> ''").groupBy("key", "page_id").count().groupBy("key")
    groups = groups.agg(F.sum("count").alias("n"), F.max(F.struct("page_id", "count")).alias("b")).where("n > 1")
    groups = materialize(groups.select("key", F.col("b.page_id").alias("best"), F.col("b.count").alias("ties")))
    met = join_checked(rows, groups, "key", "left", F.col("page_id"))
    copy, tied = F.col("ties").isNotNull(), F.coalesce(F.col("page_id").eqNullSafe(F.col("best")) & F.col("ties").isNotNull(), F.lit(False))
    kept = ["page_id", "url", "payload", F.when(copy & ~tied, "revisit").otherwise("response").alias("record_type"), F.when(copy & ~tied, F.col("best")).alias("refers_to")]
    several = tied & (F.col("ties") > 1)
    if not has_rows(groups.where("ties > 1")):
        return met.select(*kept)
    first = F.row_number().over(Window.partitionBy("key").orderBy("url")) == 1
    repeated = met.where(several).withColumn("first", first)
    repeated = repeated.select("page_id", "url", "payload", F.when(F.col("first"), "response").otherwise("revisit").alias("record_type"), F.when(~F.col("first"), F.col("best")).alias("refers_to"))
    return met.where(~several).select(*kept).unionByName(repeated)


def record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if record_type == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if record_type == "revisit":
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += [f"WARC-Block-Digest: sha1:{_digest(hashlib.sha1(block))}", f"WARC-Payload-Digest: sha1:{_digest(hashlib.sha1(payload))}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + pack.flush()


def write_archives(decided: DataFrame, root: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives under ``root`` (a folder that all executors share); the manifest has their path, records and bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(root)
        name, records, size, out = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    where.create_dir(path, recursive=True)
                    out = where.open_output_stream(f"{path}/{name}", compression=None)
                size += out.write(data := record(*(batch.column(c)[i].as_py() for c in range(5)), date)) or len(data)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    rows = decided.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "payload", "record_type", F.col("refers_to").cast("long"))
    return materialize(rows.mapInArrow(write, "path string, records long, bytes long"))


class _Members:
    """Reads what the gzip members of a stream hold, one member at a time."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.raw, self.inner, self.ready = stream, b"", None, b""

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the stream."""
        if self.inner is not None:
            self.raw = self.inner.unused_data
        self.raw = self.raw or self.stream.read(_BLOCK)
        self.inner, self.ready = (zlib.decompressobj(31), b"") if self.raw else (None, b"")
        return self.inner is not None

    def read(self) -> bytes:
        """Some bytes of the member; none at its end."""
        if self.ready:
            data, self.ready = self.ready, b""
            return data
        while not self.inner.eof:
            raw = self.inner.unconsumed_tail or self.raw or self.stream.read(_BLOCK)
            self.raw = b""
            if not raw:
                raise ValueError("the archive ends within a member")
            if data := self.inner.decompress(raw, _BLOCK):
                return data
        return b""

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        data = b""
        while mark not in data:
            more = self.read()
            if not more or len(data) > most:
                raise ValueError("a header has no end")
            data += more
        head, _, self.ready = data.partition(mark)
        return head

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            data = self.read()
            if not data:
                raise ValueError("a block is shorter than its Content-Length")
            data, self.ready = data[:n], data[n:]
            n -= len(data)
            yield data


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def read_records(stream: BinaryIO, with_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order, verified."""
    members = _Members(stream)
    while members.next_member():
        head = _fields(members.until(b"\r\n\r\n"))
        left, block, payload = int(head["content-length"]), hashlib.sha1(), hashlib.sha1()
        http, length, kept = b"", 0, []
        for data in members.exactly(left):
            block.update(data)
            if http is not None:
                http += data
                if b"\r\n\r\n" not in http:
                    continue
                inner, _, data = http.partition(b"\r\n\r\n")
                stated, http = int(_fields(inner)["content-length"]), None
            payload.update(data)
            length += len(data)
            if with_payload:
                kept.append(data)
        if b"".join(iter(members.read, b"")) != b"\r\n\r\n":
            raise ValueError("a record does not end as its Content-Length says")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        revisit = head["warc-type"] == "revisit"
        if _digest(block) != head["warc-block-digest"].removeprefix("sha1:") or (not revisit and (_digest(payload) != digest or length != stated)):
            raise ValueError(f"{head['warc-record-id']}: digest or length is wrong")
        yield {
            "page_id": _page_of(head["warc-record-id"]), "url": head.get("warc-target-uri"), "payload_bytes": stated, "payload_digest": digest,
            "record_type": head["warc-type"], "refers_to": _page_of(head.get("warc-refers-to")), "payload": b"".join(kept) if with_payload and not revisit else None,
        }


_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of all archives of a manifest (column path); payload is null unless asked for, and for revisits."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                where, path = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                try:
                    with where.open_input_stream(path, compression=None) as stream:
                        for row in read_records(stream, with_payload):
                            rows.append(row)
                            size += len(row["payload"] or b"")
                            if len(rows) >= 5000 or size > 1 << 24:
                                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
                                rows, size = [], 0
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{uri}: {e}") from e
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    paths = manifest.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(read, _SCHEMA)  # a stated number, so that AQE leaves one task for each archive


def archive_root(spark: SparkSession) -> str:
    """A new folder for archives, as a URI, in the folder that all executors share."""
    root = scratch(spark)
    return root if ":" in root else f"file://{root}"


def write_and_read(pages: DataFrame, min_bytes: int = 0, **names: str) -> DataFrame:
    """All pages through archives and back; no payloads."""
    manifest = write_archives(decide(pages, min_bytes, **names), archive_root(pages.sparkSession))
    return read_archives(manifest).drop("payload")
