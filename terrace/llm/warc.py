"""WARC archives: a record per page, one gzip member per record, and a sequential reader.

The writer decides response or revisit from digests alone, then writes files of
bounded size into a shared folder through the path's own file system. The reader
inflates member after member with a fixed buffer, frames each block by its
Content-Length and checks block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import scratch, settings, table_of

ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 16
WRITTEN = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class BrokenArchive(ValueError):
    """A record whose framing or digest is wrong."""


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, first: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header alone as its block."""
    http = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if first else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "WARC-Target-URI: " + " ".join((url or "").split()),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{sha1(block)}", f"WARC-Payload-Digest: sha1:{digest}",
        f"Page-Payload-Length: {len(payload)}",
    ]
    if not first:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` as (page_id, url, payload, digest, keeper): keeper is the page holding an equal payload, if another.

    Only digests and lengths are shuffled to find the keepers; a group of copies
    collapses in partial aggregation.
    """
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    keepers = source.filter(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("keeper"))
    slim = source.select("page_id", "digest", "n").filter(F.col("n") >= least_bytes)
    revisits = slim.join(keepers, ["digest", "n"]).filter(F.col("page_id") != F.col("keeper")).select("page_id", "digest", "n", "keeper").distinct()
    return source.join(revisits, ["page_id", "digest", "n"], "left").select("page_id", "url", "payload", "keeper")


def write(planned: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write archives into ``folder``; (path, n_records) of each. Lazy: an action writes.

    A task writes under names of its own attempt and returns them, so a repeated
    or speculative attempt never touches the files of another one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem = f"{root}/pages-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, size, count, number = None, 0, 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, keeper in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    path = f"{stem}-{number:05d}.warc.gz"
                    out, size, count, number = store.open_output_stream(path, compression=None), 0, 0, number + 1
                data = payload.as_py()
                to = keeper.as_py()
                packed = member(record(page_id.as_py(), url.as_py(), data, sha1(data), to, to is None))
                out.write(packed)
                size, count = size + len(packed), count + 1
                if size >= roll_bytes:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield table_of({"path": [p for p, _ in done], "n_records": [n for _, n in done]}, WRITTEN)

    return planned.select("page_id", "url", "payload", "keeper").mapInArrow(run, "path string, n_records long")


class _Member:
    """Bytes of a file, one gzip member after another, inflated bit by bit."""

    def __init__(self, stream):
        self.stream, self.raw, self.text, self.unpacker = stream, b"", b"", None

    def next(self) -> bool:
        """Go to the next member; False at the end of the file."""
        self.raw = self.raw or self.stream.read(READ_BYTES)
        self.text, self.unpacker = b"", zlib.decompressobj(31)
        return bool(self.raw)

    def more(self) -> bool:
        if self.unpacker.eof:
            return False
        self.raw = self.raw or self.stream.read(READ_BYTES)
        if not self.raw:
            raise BrokenArchive("a member ends early")
        self.text += self.unpacker.decompress(self.raw, READ_BYTES)
        self.raw = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.text.find(mark)) < 0:
            if not self.more():
                raise BrokenArchive("a header has no end")
        head, self.text = self.text[:at], self.text[at + len(mark):]
        return head

    def take(self, n: int) -> bytes:
        parts = [self.text]
        have = len(self.text)
        self.text = b""
        while have < n:
            if not self.more():
                raise BrokenArchive("a block ends early")
            parts.append(self.text)
            have += len(self.text)
            self.text = b""
        data = b"".join(parts)
        self.text = data[n:]
        return data[:n]


def _page(reference: str | None) -> int | None:
    number = reference[len("<urn:page:"):-1] if reference else ""
    return int(number) if number else None


def read_stream(stream) -> Iterator[tuple]:
    """Records of one archive in order; raises ``BrokenArchive`` on a wrong digest or length."""
    file = _Member(stream)
    while file.next():
        lines = file.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise BrokenArchive(f"not a record: {lines[0][:40]!r}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
        block = file.take(int(head["content-length"]))
        if file.take(4) != b"\r\n\r\n" or file.text or file.more() and file.text:
            raise BrokenArchive("a record is not one member")
        if "sha1:" + sha1(block) != head["warc-block-digest"]:
            raise BrokenArchive("a block digest is wrong")
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        first = head["warc-type"] == "response"
        size = int(head["page-payload-length"])
        if first and (len(payload) != size or sha1(payload) != digest):
            raise BrokenArchive("a payload digest is wrong")
        yield (_page(head["warc-record-id"]), head["warc-target-uri"], size, digest, head["warc-type"], None if first else _page(head["warc-refers-to"]), payload if first else None)


def read(paths: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in column ``path``, one row each, in file order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for row in read_stream(stream):
                        rows.append(row if with_payload else (*row[:6], None))
                        size += len(rows[-1][6] or b"")
                        if len(rows) >= 1000 or size >= 8 << 20:
                            yield table_of(dict(zip(RECORDS.names, zip(*rows, strict=True), strict=True)), RECORDS)
                            rows, size = [], 0
                if rows:
                    yield table_of(dict(zip(RECORDS.names, zip(*rows, strict=True), strict=True)), RECORDS)

    return paths.select("path").mapInArrow(run, DDL)


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back.

    A null html counts as empty; of equal payloads the one with the largest
    page_id is the response. Repeated rows of that page are all responses, a null
    page_id stays a response under a record without number, a null url is empty;
    an empty table gives no rows; other columns are ignored.
    """
    settings(spark)
    folder = scratch(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else "file://" + folder
    listing = scratch(spark, "warc-files")
    write(plan(pages), folder).write.parquet(listing)
    files = spark.read.schema("path string, n_records long").parquet(listing)
    n = max(1, files.count())
    return read(files.repartition(n, "path") if n > 1 else files, folder, with_payload)
