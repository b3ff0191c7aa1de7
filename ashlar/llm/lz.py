"""Lempel-Ziv phrase fingerprints (10).

A text is parsed left to right into dictionary phrases, each the shortest string that is not yet a phrase (LZ78).  The
phrases' hashes, thinned to the ``SIZE`` smallest, are its minimum-hash signature; two signatures are compared over
the smallest hashes of their union, which estimates the share of phrases that two texts have in common.  The
fingerprint is the signature in hexadecimal.

``edits`` compares each document with an edited copy and with the next document, in descending order of doc_id.
A range of ids is a task, sorted; the first document of each range also goes to the range before, so no row travels
through one task.

Defined results: null and empty texts have no phrases and an empty fingerprint, and are alike (1.0) to each other
and unlike (0.0) anything else; a document alone is its own next; rows with one doc_id stand in the order of their
text's hash; rows with a null doc_id come last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, partitions, prepare, row_key, table
from .huffman import _ranges

#: Hashes kept of a text.
SIZE = 64


class Parse:
    """The phrases of a text so far, as a tree of dictionaries; ``back`` takes a text's ending away for another one."""

    __slots__ = ("data", "root", "node", "cuts", "grown")

    def __init__(self):
        self.data, self.root = b"", {}
        self.node = self.root
        #: Where phrases end; what follows the last of them is not yet a phrase.
        self.cuts = [0]
        #: The node below which each phrase was hung.
        self.grown: list[dict] = []

    def feed(self, data: bytes) -> Parse:
        root, node, cut, hung = self.root, self.node, self.cuts.append, self.grown.append
        for at, c in enumerate(data, len(self.data) + 1):
            below = node.get(c)
            if below is None:
                node[c] = {}
                hung(node)
                cut(at)
                node = root
            else:
                node = below
        self.node = node
        self.data += data
        return self

    def mark(self) -> tuple[int, int, dict]:
        return len(self.data), len(self.grown), self.node

    def back(self, mark: tuple[int, int, dict]) -> Parse:
        """As it was at the mark: the youngest branches are the last entries of their nodes."""
        size, phrases, self.node = mark
        for node in reversed(self.grown[phrases:]):
            node.popitem()
        del self.grown[phrases:], self.cuts[phrases + 1 :]
        self.data = self.data[:size]
        return self

    def signature(self) -> np.ndarray:
        """The smallest hashes of the phrases, ascending."""
        cuts = np.array(self.cuts, np.int64)
        h = RangeHash(np.frombuffer(self.data, np.uint8, int(cuts[-1])))(cuts[:-1], cuts[1:])
        h = (h >> np.uint64(32)).astype(np.uint32)
        least = np.unique(np.partition(h, 2 * SIZE)[: 2 * SIZE]) if len(h) > 2 * SIZE else h  # phrases differ, and so do nearly all hashes
        return (least if len(least) >= SIZE else np.unique(h))[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SIZE]
    return float(np.isin(np.intersect1d(a, b, True), both).sum() / len(both))


def _hex(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> str:
    return _hex(Parse().feed((text or "").encode()).signature())


def edits(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by as many of the next document's first.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _ranges(docs, n)  # ascending

    def bucket(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbered downwards: bucket 0 has the largest ids; nulls stand in a bucket of their own at the end."""
        for b in it:
            ids = b.column("doc_id")
            at = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(), "left") if bounds else np.zeros(len(ids), np.int64)
            at = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, at)
            yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "doc_id": ids})

    # the first id of each bucket: a value for each range, from the id column alone
    firsts = sorted((r.bucket, r.doc_id) for r in docs.select("doc_id").mapInArrow(bucket, "bucket int, doc_id long").groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect())
    also = {d: firsts[i - 1][0] for i, (_, d) in enumerate(firsts) if d is not None}  # to the one before; the first of all to the last
    null_first = firsts[-2][0] if len(firsts) > 1 and firsts[-1][1] is None else None
    only_nulls = len(firsts) == 1 and firsts[0][1] is None

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, c in ((b, next(bucket(iter([b])))) for b in it):
            take, where, lent = list(range(b.num_rows)), c.column("bucket").to_pylist(), [False] * b.num_rows
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                to = also.get(d) if d is not None else null_first
                if to is not None or d is None and only_nulls:
                    take.append(i)
                    where.append(len(bounds) + 1 if to is None else to)
                    lent.append(True)
            rows = b.take(pa.array(take, pa.int64()))
            yield pa.record_batch({"bucket": pa.array(where, pa.int32()), "lent": pa.array(lent), "doc_id": rows.column("doc_id"), "text": rows.column("text"), "key": rows.column("key")})

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        at, held = None, None
        for b in it:
            rows = []
            for where, lent, d, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if where != at:
                    at, held = where, None
                n = len(text)
                keep = n - n // 3
                begun = Parse().feed(text[:keep].encode())
                mark = begun.mark()
                sign = begun.feed(text[keep:].encode()).signature()
                begun.back(mark)
                if held is not None:
                    d0, text0, begun0, sign0 = held
                    n0 = len(text0)
                    k0 = n0 // 3
                    edited = text0[: n0 - k0] + text[:k0]
                    sign1 = begun0.feed(text[:k0].encode()).signature()
                    rows.append((d0, n0, hashlib.sha256(edited.encode()).hexdigest(), _hex(sign0), _hex(sign1), likeness(sign0, sign1), likeness(sign0, sign)))
                # what is lent closes its bucket; of rows with one id the first is next
                held = None if lent else (d, text, begun, sign)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    dealt = docs.withColumn("key", row_key("text")).mapInArrow(deal, "bucket int, lent boolean, doc_id long, text string, key long").repartitionById(len(bounds) + 2, F.col("bucket"))
    dealt = dealt.sortWithinPartitions("bucket", "lent", F.desc_nulls_last("doc_id"), "key")
    return dealt.drop("key").mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return edits(table(spark, sf_dir, "documents"))
