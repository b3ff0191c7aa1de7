"""WARC archives (4): a chunked record table.

A record is written as rows (record, chunk, last, data, payload_bytes, payload_digest): its bytes in pieces of at most
``CHUNK``, each with the count and digest of the payload so far, so neither writer nor reader builds a whole
record and a damaged one shows at the piece where it is damaged.  The data of a record's rows in a row are its WARC/1.1
bytes.  Of pages with equal payloads (of at least ``least`` bytes) the one with the largest page_id is the response and
the others revisit it.

Defined results: null html is an empty payload; repeated rows are records of their own with equal results; a row with
a null page_id revisits the response with its payload, or is a response if no page with an id has it; null urls
are empty; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, partitions, row_key, shared_folder, table
from .components import stored

CHUNK = 1 << 16
CHUNKS = "archive int, record long, record_id string, chunk int, last boolean, data binary, payload_bytes long, payload_digest string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE = re.compile(rb"[\x00-\x1f]+")


def digest(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def _name(page_id: int | None, key: int) -> str:
    return f"urn:x-page:{page_id}" if page_id is not None else f"urn:x-row:{key & 0xFFFFFFFFFFFFFFFF:016x}"


def head(page_id: int | None, key: int, url: str | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """Everything of a record before its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    kind = "response" if refers_to is None else "revisit"
    more = "" if refers_to is None else f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <{_name(refers_to, 0)}>\r\n"
    body = len(http) + (size if refers_to is None else 0)
    target = _LINE.sub(b" ", (url or "").encode())
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{_name(page_id, key)}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: ".encode() + target
            + f"\r\nWARC-Payload-Digest: sha1:{sha1}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {body}\r\n\r\n".encode() + http)


def record_chunks(first: bytes, payload: memoryview | bytes, chunk: int) -> Iterator[tuple[bytes, int, str]]:
    """(data, payload bytes so far, their digest) of each piece; no piece is longer than chunk, or than the head."""
    sha, done, view = hashlib.sha1(), 0, memoryview(payload)
    take = max(0, chunk - len(first) - 4)
    lead = first
    while True:
        piece = view[done : done + take]
        sha.update(piece)
        done += len(piece)
        end = done == len(view)
        yield lead + bytes(piece) + (b"\r\n\r\n" if end else b""), done, digest(sha)
        if end:
            return
        lead, take = b"", max(1, chunk - 4)


class Reader:
    """Takes the pieces of one record in order; holds no more than its head and one piece."""

    def __init__(self):
        self.head, self.sha, self.seen, self.fields = b"", hashlib.sha1(), 0, None

    def feed(self, data: bytes, so_far: int, sha1: str) -> None:
        if self.fields is None:
            self.head += data
            warc = self.head.find(b"\r\n\r\n")
            http = self.head.find(b"\r\n\r\n", warc + 4) if warc >= 0 else -1
            if http < 0:
                return
            self.fields = {}
            for mark, block in (("", self.head[:warc]), ("http:", self.head[warc + 4 : http])):
                for line in block.split(b"\r\n")[1:]:
                    k, _, v = line.partition(b": ")
                    self.fields[mark + k.decode()] = v.decode()
            data, self.head = self.head[http + 4 :], b""
            self.size = int(self.fields["http:Content-Length"])
            self.left = 0 if self.fields["WARC-Type"] == "revisit" else self.size
        piece = memoryview(data)[: self.left]
        self.left -= len(piece)
        self.seen += len(piece)
        self.sha.update(piece)
        if self.fields["WARC-Type"] == "response" and (self.seen != so_far or digest(self.sha) != sha1):
            raise ValueError(f"record {self.fields['WARC-Record-ID']} is damaged before payload byte {so_far}")

    def result(self) -> tuple[int | None, int, str, str, int | None]:
        f = self.fields or {}
        sha1 = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if self.left or f["WARC-Type"] == "response" and digest(self.sha) != sha1:
            raise ValueError(f"record {f['WARC-Record-ID']} is cut short or damaged")
        return _page(f["WARC-Record-ID"]), self.size, sha1, f["WARC-Type"], _page(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None


def _page(name: str) -> int | None:
    kind, _, value = name.strip("<>").rpartition(":")
    return int(value) if kind == "urn:x-page" else None


def write(pages: DataFrame, folder: str, least: int = 0, chunk: int = CHUNK) -> None:
    """Writes a record per page to the folder, as rows of the chunk table."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("html"), row_key("url", "html").alias("key"))

    def digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            html = b.column("html").to_pylist()
            yield pa.record_batch({"page_id": b.column("page_id"), "key": b.column("key"), "sha1": pa.array([digest(hashlib.sha1(x)) for x in html]), "size": pa.array([len(x) for x in html], pa.int64())})

    # small rows only: who revisits whom is settled without the payloads
    sums = stored(pages.mapInArrow(digests, "page_id long, key long, sha1 string, size long").distinct(), "digests")
    largest = sums.where(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("response"))
    roles = sums.join(largest, "sha1", "left").select("page_id", "key", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))
    roles = roles.withColumnsRenamed({"page_id": "_page", "key": "_key"})

    def records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = TaskContext.get().partitionId() if TaskContext.get() else 0
        record = archive << 36
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        names = ["archive", "record", "record_id", "chunk", "last", "data", "payload_bytes", "payload_digest"]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string()]
        for b in it:
            for page_id, url, html, key, sha1, refers in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                first = head(page_id, key, url, len(html), sha1, refers)
                payload = b"" if refers is not None else html
                name, n = _name(page_id, key), 0
                made = record_chunks(first, payload, chunk)
                here = next(made)
                while here:
                    after = next(made, None)
                    rows.append((archive, record, name, n, after is None, *here))
                    held += len(here[0])
                    if held > 8 << 20:
                        yield batch()
                        rows, held = [], 0
                    here, n = after, n + 1
                record += 1
        if rows:
            yield batch()

    joined = pages.join(roles, pages.page_id.eqNullSafe(F.col("_page")) & (pages.key == F.col("_key")))
    joined.select("page_id", "url", "html", "key", "sha1", "refers_to").mapInArrow(records, CHUNKS).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to; every digest is checked."""

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = None, []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for b in it:
            for n, last, data, so_far, sha1 in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if n == 0:
                    reader = Reader()
                reader.feed(data, so_far, sha1)
                if last:
                    out.append(reader.result())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []

    rows = spark.read.schema(CHUNKS).parquet(folder).select("chunk", "last", "data", "payload_bytes", "payload_digest", "record")
    result = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    single = rows.where("chunk = 0 and last").drop("record").mapInArrow(parse, result)
    several = rows.where("not (chunk = 0 and last)").repartition(partitions(spark), "record").sortWithinPartitions("record", "chunk").drop("record")
    return single.unionByName(several.mapInArrow(parse, result))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = shared_folder(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder)


#: Base 32 from the hexadecimal SHA-1: five digits make four letters.
ORACLE = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""
