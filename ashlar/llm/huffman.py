"""Token-ID output (5): canonical length-limited Huffman files with independently decodable blocks.

A first pass encodes the texts and keeps their ids, dealt by ranges of doc_id; global counts of the ids give code
lengths (package-merge, at most ``LIMIT`` bits) and so the canonical codes.  A shard is a self-contained record:
header, document table, bit-offset checkpoints of its blocks, and the bits.  Shards lie in the folder of their range,
so folders and shards in a row are the documents in ascending doc_id.  Decoding looks codes up in a table and walks all
blocks of a shard side by side.

Defined results: a null or empty text is its end id alone; rows with one doc_id are told apart by their text and
follow each other; rows with a null doc_id come last; an empty table gives no shards; other columns are ignored.
A shard holds whole documents, so memory follows the longest one.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, prepare, row_key, shared_folder, table
from .tokens import encoder, vocabulary

LIMIT = 18
BLOCK = 256
SHARD = 1 << 17
#: Bytes of text in a range, about, where the session's shuffle partitions allow as many ranges: each range is a file of ids
#: and a file of shards, and Hadoop's local file system spawns three commands for a file.
RANGE = 1 << 23
MAGIC = b"ASHF\x01"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; ids that never occur get 0."""
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    w = counts[order].astype(np.int64)
    level, leaf = w, [np.ones(n, bool)]
    for _ in range(limit - 1):
        m = len(level) // 2 * 2
        merged = np.concatenate([w, level[0:m:2] + level[1:m:2]])
        o = np.argsort(merged, kind="stable")
        level = merged[o]
        leaf.append(o < n)
    take = 2 * n - 2
    for flags in reversed(leaf):
        own = int(flags[:take].sum())
        out[order[:own]] += 1
        take = 2 * (take - own)
    return out


class Codebook:
    """Canonical codes of given lengths, and the decoding table."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.limit = max(1, int(lengths.max(initial=1)))
        ids = np.flatnonzero(lengths)
        ids = ids[np.lexsort((ids, lengths[ids]))]
        size = np.uint64(1) << (self.limit - lengths[ids]).astype(np.uint64)
        start = np.cumsum(size) - size
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ids] = start >> (self.limit - lengths[ids]).astype(np.uint64)
        self.symbol = np.zeros(1 << self.limit, np.uint32)
        filled = np.repeat(ids, size.astype(np.int64))
        self.symbol[: len(filled)] = filled
        self.step = self.lengths[self.symbol].astype(np.int64)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(bit offset of each block, the bits)."""
        size = self.lengths[ids].astype(np.int64)
        end = np.cumsum(size)
        pos = end - size
        v = self.codes[ids] << (64 - (pos & 31) - size).astype(np.uint64)
        word = pos >> 5
        out = np.zeros(int(word[-1]) + 2 if len(ids) else 0, np.uint64)
        if len(ids):
            first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
            at = word[first]
            out[at] += np.add.reduceat(v >> np.uint64(32), first)  # the bits of different codes never meet
            out[at + 1] += np.add.reduceat(v & np.uint64(0xFFFFFFFF), first)
        return pos[::BLOCK].astype("<u4"), out.astype(">u4").tobytes()

    def decode(self, n: int, blocks: np.ndarray, bits: bytes) -> np.ndarray:
        raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
        pos = blocks.astype(np.int64)
        out = np.empty((BLOCK, len(pos)), np.uint32)
        top, mask = 32 - self.limit, np.uint32((1 << self.limit) - 1)
        for j in range(min(BLOCK, n)):
            at = np.minimum(pos, 8 * len(bits))
            code = window[at >> 3] >> (top - (at & 7)).astype(np.uint32) & mask
            out[j] = self.symbol[code]
            pos = at + self.step[code]
        return out.T.reshape(-1)[:n]


def write_shard(book: Codebook, start: int, doc_ids: list, ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids)
    blocks, bits = book.encode(flat)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<QIIII", start, len(doc_ids), len(flat), len(blocks), len(bits))
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array([len(x) for x in ids], "<u4").tobytes(), blocks.tobytes(), bits])


def read_shard(book: Codebook, shard: bytes) -> tuple[int, list, list[np.ndarray]]:
    """(ids before it, doc_ids, ids of each)."""
    if shard[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard")
    at = len(MAGIC)
    start, docs, n, n_blocks, n_bits = struct.unpack_from("<QIIII", shard, at)
    at += struct.calcsize("<QIIII")
    parts = []
    for kind, size in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", n_blocks), ("u1", n_bits)):
        parts.append(np.frombuffer(shard, kind, size, at))
        at += parts[-1].nbytes
    flat = book.decode(n, parts[3], parts[4].tobytes())
    return start, [int(d) if k else None for d, k in zip(parts[0], parts[1], strict=True)], np.split(flat, np.cumsum(parts[2])[:-1])


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """Bounds of n ranges of doc_id; only that column is read."""
    got = docs.where("doc_id is not null").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    return sorted({int(x) for x in got})


def _by_size(docs: DataFrame, most: int) -> int:
    """How many ranges the texts fill, at most so many; a row counts 32 bytes besides its text."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 32)).first()[0] or 0
    return min(most, -(-size // RANGE))


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> None:
    """Encodes every text and writes codebook and shards to the folder."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", row_key("text").alias("key"))
    bounds = _ranges(docs, _by_size(docs, partitions(spark)))

    def tokenize(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, z = encoder(path), np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(1)
        for b in it:
            doc_ids = b.column("doc_id").to_pylist()
            ids = [np.frombuffer(enc.ids(t or "") + end, "<u4") for t in b.column("text").to_pylist()]
            small = [z.compress(x.astype("<u2") if x.max() < 65536 else x) for x in ids]
            yield pa.record_batch({
                "bucket": pa.array([len(bounds) if d is None else bisect_left(bounds, d) for d in doc_ids], pa.int32()), "doc_id": b.column("doc_id"), "key": b.column("key"),
                "n": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array(small, pa.binary()),
            })

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for b in it:
            start = []
            for k, c in zip(b.column("bucket").to_pylist(), b.column("n").to_pylist(), strict=True):
                if k != last:
                    last, total = k, 0
                start.append(total)
                total += c
            yield pa.record_batch({"bucket": b.column("bucket"), "start": pa.array(start, pa.int64()), "doc_id": b.column("doc_id"), "n": b.column("n"), "ids": b.column("ids")})

    dealt = docs.mapInArrow(tokenize, "bucket int, doc_id long, key long, n long, ids binary").repartitionById(len(bounds) + 1, F.col("bucket"))
    dealt = dealt.sortWithinPartitions("bucket", F.asc_nulls_last("doc_id"), "key")
    dealt.mapInArrow(number, "bucket int, start long, doc_id long, n long, ids binary").write.parquet(f"{folder}/ids", compression="none")
    kept = spark.read.parquet(f"{folder}/ids")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in it:
            got = np.bincount(np.concatenate([_ids(x, c) for x, c in zip(b.column("ids").to_pylist(), b.column("n").to_pylist(), strict=True)] or [np.zeros(0, np.uint32)]))
            if len(got) > len(total):
                got, total = total, got
            total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(used, pa.int64()), "c": pa.array(total[used])})

    # bounded by the vocabulary, and by the number of ranges
    counted = {r.id: r.c for r in kept.mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()}
    counts = np.zeros(max(counted, default=0) + 1, np.int64)
    counts[list(counted)] = list(counted.values())
    lengths = code_lengths(counts)
    base, total = {}, 0
    for r in sorted(kept.groupBy("bucket").agg(F.sum("n").alias("n")).collect()):
        base[r.bucket], total = total, total + r.n
    spark.createDataFrame([(bytearray(lengths.tobytes()), total)], "lengths binary, ids long").coalesce(1).write.parquet(f"{folder}/codebook")

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)
        rows: list[tuple] = []  # of the shard in hand: bucket, start, doc_id, ids

        def shard() -> pa.RecordBatch:
            bucket, start = rows[0][:2]
            made = write_shard(book, start, [r[2] for r in rows], [r[3] for r in rows])
            return pa.record_batch({"bucket": pa.array([bucket], pa.int32()), "start": pa.array([start], pa.int64()), "shard": pa.array([made], pa.binary())})

        for b in it:
            for bucket, start, d, c, x in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                start += base[bucket]
                follows = rows and rows[-1][0] == bucket and rows[-1][1] + len(rows[-1][3]) == start and start + c - rows[0][1] <= SHARD
                if rows and not follows:
                    yield shard()
                    rows = []
                rows.append((bucket, start, d, _ids(x, c)))
        if rows:
            yield shard()

    kept.mapInArrow(encode, "bucket int, start long, shard binary").write.partitionBy("bucket").parquet(f"{folder}/shards", compression="none")


def _ids(blob: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32, and the ids if wanted."""
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/codebook").first().lengths, np.uint8)

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)
        for b in it:
            for shard in b.column("shard").to_pylist():
                start, docs, ids = read_shard(book, shard)
                n = np.array([len(x) for x in ids], np.int64)
                cols = {"doc_id": pa.array(docs, pa.int64()), "start": pa.array(start + np.cumsum(n) - n), "n_tokens": pa.array(n), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                yield pa.record_batch(cols)

    shards = spark.read.schema("start long, shard binary, bucket int").parquet(f"{folder}/shards").select("shard")
    return shards.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = shared_folder(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder)
    return read(spark, folder)
