"""Packing (2): harmonic packing into sequences of a fixed capacity.

Each worker packs its own share of about ``SHARE`` tokens, with no word to the others.  Whole capacities are cut off
long documents; what is left of each is put by its length in class k, (C/(k+1), C/k], and k of a class make a bin.
What a bin lacks is cut from the worker's stream of fillers: remainders of the last class, remainders too few for a
bin, and the cut-off capacities.  Bins for which the stream does not suffice join the stream; what the stream has
left at the end fills sequences in a row, and its tail is cut to powers of two, which need no padding.

Defined results: a null or empty text is one end token; repeated rows are packed each for itself; a null doc_id is
carried; an empty table gives no pieces; other columns are ignored.  Every id lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .tokens import encoder, vocabulary

CAPACITY = 2048
CLASSES = 32
#: Tokens that a worker gathers before it packs them.
SHARE = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


@dataclass
class Sequences:
    """Pieces (document, start, length) of each sequence."""

    capacity: int
    closed: list[list[tuple[int, int, int]]] = field(default_factory=list)

    def pack(self, lengths: list[int], classes: int = CLASSES) -> list[list[tuple[int, int, int]]]:
        c = self.capacity
        groups: list[list[tuple[int, int, int]]] = [[] for _ in range(classes + 1)]
        whole, bins, stream = [], [], []
        for d, n in enumerate(lengths):
            cut = n - n % c
            if cut:
                whole.append((d, 0, cut))
            if n > cut:
                groups[min(classes, c // (n - cut))].append((d, cut, n - cut))
        stream += groups[classes]
        for k in range(1, classes):
            g = groups[k]
            full = len(g) - len(g) % k
            bins += [g[i : i + k] for i in range(0, full, k)]
            stream += g[full:]
        stream += whole
        stream.reverse()
        left = sum(x[2] for x in stream)
        for b in bins:
            gap = c - sum(x[2] for x in b)
            if gap > left:
                stream = b[::-1] + stream
                left += c - gap
                continue
            self.closed.append(b + _take(stream, gap))
            left -= gap
        while left >= c:
            self.closed.append(_take(stream, c))
            left -= c
        for bit in reversed(range(c.bit_length())):
            if left >> bit & 1:
                self.closed.append(_take(stream, 1 << bit))
        return self.closed


def _take(stream: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """The next n tokens of a stream that is kept end to start."""
    out = []
    while n:
        d, s, length = stream.pop()
        if length > n:
            stream.append((d, s + n, length - n))
            length = n
        out.append((d, s, length))
        n -= length
    return out


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, share: int = SHARE, with_ids: bool = False) -> DataFrame:
    """A row per piece; with_ids adds the piece's ids (array<int>).  One pass over the documents, no shuffle."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def packed(ids: list, toks: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        seqs = Sequences(capacity).pack([len(t) for t in toks])
        rows: list[list] = [[] for _ in range(8)]
        pieces = []
        for k, s in enumerate(seqs):
            at, total = 0, sum(x[2] for x in s)
            for d, start, length in s:
                piece = toks[d][start : start + length]
                if with_ids:
                    pieces.append(piece.astype(np.int32))
                for r, v in zip(rows, (ids[d], start, length, zlib.crc32(piece), len(toks[d]), first + k, at, total), strict=True):
                    r.append(v)
                at += length
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
        cols = {n: pa.array(r, pa.int64()) for n, r in zip(names, rows, strict=True)}
        if with_ids:
            cols["ids"] = pa.array(pieces, pa.list_(pa.int32()))
        return pa.record_batch(cols), first + len(seqs)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        ids: list = []
        toks: list[np.ndarray] = []
        held = 0
        for b in it:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                got = np.frombuffer(enc.ids(t or "") + end, "<u4")
                ids.append(d)
                toks.append(got)
                held += len(got)
                if held >= share:
                    out, first = packed(ids, toks, first)
                    yield out
                    ids, toks, held = [], [], 0
        if ids:
            yield packed(ids, toks, first)[0]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
