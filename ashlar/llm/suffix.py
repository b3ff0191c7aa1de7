"""Suffix-array dedup (1): prefix-free parsing of the corpus, in buckets.

Removed is each byte covered by a string of ``WIDTH`` bytes that also starts in a document with a smaller doc_id.

1. Parsing.  The trigger is the smallest rolling hash of ``GRAM`` bytes in the window of WIDTH bytes at a position; a
   phrase is a run of positions with one trigger, with the WIDTH - 1 bytes that follow, so every window lies in
   one phrase, and equal windows lie in phrases of one trigger wherever they occur.
2. The parse (phrase, document, place) is dealt by trigger.  A worker first keeps only its smallest document of each
   phrase: later ones are removed on the spot, so a phrase that is everywhere comes once from each worker.
   Documents after a phrase's first lose the phrase whole.
3. Only phrases that share a trigger but differ (the ends of repeats) need their bytes: one copy of each, the
   dictionary, is fetched and its suffixes are sorted to WIDTH bytes by prefix doubling.  Neighbours in that order
   with WIDTH bytes in common are the windows that phrases share.
4. The removed ranges return to their documents.

A phrase is known by its trigger and 96 bits of hash, so that no two of any corpus are taken for one another.  Since a
phrase carries the bytes that follow it, the order of the dictionary's suffixes is the corpus order as far as
WIDTH bytes tell, and the parse is grouped rather than sorted.

Defined results: null and empty texts have no bytes and lose none; a row with a null doc_id neither loses bytes nor
makes others lose any; rows with one doc_id are one document as to order, each with its own result; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OTHER, RangeHash, as_bytes, decode_few, groups_of, partitions, prepare, table
from .components import stored

WIDTH, GRAM = 50, 16
#: Bytes parsed at a time, and phrases gathered before they are dealt.
SPAN, GATHER = 1 << 18, 1 << 19
#: Phrases or ranges of a blob, and bytes of an Arrow batch given to the JVM (a batch has one blob at least): it copies a
#: blob into arrays of up to twice its size, and its heap grows in jumps where many arrays are of half a megabyte or more.
PIECE, BATCHED = 1 << 12, 1 << 20
#: Bytes of text that a home holds, by the corpus's size; there are at least two homes a shuffle partition.
HOME = 64 << 20
#: Bytes of text behind a task, and so a file, where the matched parse of a small table is stored; there is at least one task a core.
STORED = 8 << 20
_PHRASES, _RANGES, _WANTED = 0, 1, 2
_DEALT = "to int, kind int, blob binary"
_DEALT_ARROW = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_U8, _U4, _DOC, _ROW, _AT = "<u8", "<u4", "<i8", "<u4", "<u4"


def pack(*columns: tuple[str, np.ndarray]) -> bytes:
    """Columns as planes of bytes, compressed."""
    n = len(columns[0][1])
    planes = [np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(n, -1).T.tobytes() for kind, values in columns]
    return struct.pack("<I", n) + zstandard.ZstdCompressor(1).compress(b"".join(planes))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", blob)
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob[4:]) if n else b"", 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def phrases(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(trigger, two hashes, document, first position in the buffer, windows) of each phrase."""
    n = len(data) - WIDTH + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z.astype(np.uint32), z, z, z
    hashed = RangeHash(data)
    low = hashed.rolling(GRAM)
    span, want = 1, WIDTH - GRAM + 1
    while 2 * span <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < want:
        low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
    low = low[:n]
    ends = np.zeros(n + 1, np.int32)  # positions from which a window would leave its document
    np.add.at(ends, np.minimum(np.maximum(off[1:-1] - WIDTH + 1, off[:-2]), n), 1)
    np.add.at(ends, np.minimum(off[1:-1], n), -1)
    ok = np.cumsum(ends[:-1]) == 0
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (low[1:] != low[:-1])
    cut = np.zeros(n + 1, bool)
    cut[off[off <= n]] = True
    first |= ok & cut[:-1]
    last = ok.copy()
    last[:-1] &= ~ok[1:] | first[1:]
    p, q = np.flatnonzero(first), np.flatnonzero(last)
    return low[p], hashed(p, q + WIDTH), (RangeHash(data, OTHER)(p, q + WIDTH) >> np.uint64(32)).astype(np.uint32), np.searchsorted(off, p, "right") - 1, p, q - p + 1


def _spans(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, bytes of its document before it) in parts of bounded size."""
    data, off = as_bytes(b.column("text"))
    for lo, hi in groups_of(off, SPAN):
        size = int(off[hi] - off[lo])
        if size <= 4 * SPAN:
            yield data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo, 0
        else:  # one long text, in parts that share no window
            for s in range(0, size, SPAN):
                part = data[off[lo] + s : min(off[lo] + s + SPAN + WIDTH - 1, off[hi])]
                yield part, np.array([0, len(part)]), lo, s


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Touching ranges of a row made one; in ascending order of row and start."""
    if not len(row):
        return row, start, end
    o = np.lexsort((start, row))
    row, start, end = row[o], start[o], end[o]
    # the furthest end so far in the row: rows are set apart by more than any end
    apart = (np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + apart)
    new = np.concatenate([[True], (start + apart)[1:] > far[:-1]])
    at = np.flatnonzero(new)
    return row[at], start[at], (far - apart)[np.concatenate([at[1:] - 1, [len(row) - 1]])]


def _by(to: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows for each destination, in their order, PIECE at a time."""
    o = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[o], np.arange(n + 1))
    for k in range(n):
        for a in range(cut[k], cut[k + 1], PIECE):
            yield k, o[a : min(a + PIECE, cut[k + 1])]


def _rows(made: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCHED bytes."""
    part, held = [], 0
    for x in made:
        if part and held + len(x[2]) > BATCHED:
            yield _batch(part)
            part, held = [], 0
        part.append(x)
        held += len(x[2])
    if part:
        yield _batch(part)


def _batch(made: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    to, kind, blob = zip(*made, strict=True)
    return pa.record_batch([pa.array(to, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], schema=_DEALT_ARROW)


def _parse(buckets: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for b in it:
            ids, rows, homes = (b.column(c).to_numpy() for c in ("doc_id", "row", "home"))
            for data, off, first, before in _spans(b):
                trigger, phrase, other, at, p, n = phrases(data, off)
                parts.append((trigger, phrase, other, ids[first + at], rows[first + at], homes[first + at], p - off[at] + before, n))
                held += len(p)
            if held >= GATHER:
                yield from _rows(deal(parts))
                parts, held = [], 0
        if parts:
            yield from _rows(deal(parts))

    def deal(parts: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, bytes]]:
        trigger, phrase, other, doc, row, home, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        later = _later(trigger, phrase, other, doc)
        if later.any():
            yield from _range_rows(doc[later], row[later], home[later], at[later], at[later] + n[later] + WIDTH - 1)
        keep = ~later
        trigger, phrase, other, doc, row, home, at, n = (x[keep] for x in (trigger, phrase, other, doc, row, home, at, n))
        for k, i in _by(bucket_of(trigger, buckets), buckets):
            yield k, _PHRASES, pack((_U8, trigger[i]), (_U8, phrase[i]), (_U4, other[i]), (_DOC, doc[i]), (_ROW, row[i]), (_AT, home[i]), (_AT, at[i]), (_AT, n[i]))

    return run


def bucket_of(trigger: np.ndarray, buckets: int) -> np.ndarray:
    return (trigger >> np.uint64(12)).astype(np.int64) % buckets  # triggers are minima: their high bits are not even


def _later(trigger: np.ndarray, phrase: np.ndarray, other: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which are of a document after the first that has the phrase."""
    out = np.zeros(len(trigger), bool)
    if not len(trigger):
        return out
    key = trigger ^ (phrase * np.uint64(0x9E3779B97F4A7C15))
    o = np.argsort(key)
    same = key[o][1:] == key[o][:-1]
    twice = np.zeros(len(o), bool)
    twice[1:] |= same
    twice[:-1] |= same
    o = o[twice]  # the rest is alone
    if not len(o):
        return out
    o = o[np.lexsort((doc[o], other[o], phrase[o], trigger[o]))]
    t, p, q, d = trigger[o], phrase[o], other[o], doc[o]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
    out[o] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _range_rows(doc: np.ndarray, row: np.ndarray, home: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Blobs of merged ranges for the homes of their documents."""
    o = np.lexsort((start, row, doc))
    doc, row, home = doc[o], row[o], home[o]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
    number, first = np.cumsum(new) - 1, np.flatnonzero(new)
    r, s, e = _merged(number, start[o].astype(np.int64), end[o].astype(np.int64))
    doc, row, home = doc[first][r], row[first][r], home[first][r]
    places, where = np.unique(home, return_inverse=True)
    return [(int(places[k]), _RANGES, pack((_DOC, doc[i]), (_ROW, row[i]), (_AT, s[i]), (_AT, e[i]))) for k, i in _by(where, len(places))]


def _grouped(work):
    """work(blobs) for each bucket of rows sorted by kind and bucket; other rows pass.

    What the buckets of a task find is gathered before it is dealt to homes, so there are rows for each task and home
    rather than for each bucket and home.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs, found, held = None, [], [], 0
        for b in it:
            passed = []
            for to, kind, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if kind != _PHRASES:
                    passed.append((to, kind, blob))
                    continue
                if to != at and blobs:
                    found.append(work(blobs))
                    held += sum(len(x[0]) for x in found[-1])
                    blobs = []
                    if held > GATHER:
                        yield from _rows(_dealt(found))
                        found, held = [], 0
                at = to
                blobs.append(blob)
            yield from _rows(passed)
        if blobs:
            found.append(work(blobs))
        if found:
            yield from _rows(_dealt(found))

    return run


def _dealt(found: list[tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]]) -> list[tuple[int, int, bytes]]:
    """Rows of gathered (doc, row, home, start, end) and (home, trigger, doc, row, at, n)."""
    ranges, wanted = ([np.concatenate(c) for c in zip(*x, strict=True)] for x in zip(*found, strict=True))
    made = _range_rows(*ranges) if len(ranges[0]) else []
    if len(wanted[0]):
        home, trigger, doc, row, at, n = wanted
        places, where = np.unique(home, return_inverse=True)
        for k, i in _by(where, len(places)):
            made.append((int(places[k]), _WANTED, pack((_U8, trigger[i]), (_DOC, doc[i]), (_ROW, row[i]), (_AT, at[i]), (_AT, n[i]))))
    return made


def _match(blobs: list[bytes]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of one bucket: ranges of phrases seen before, and the phrases whose bytes are wanted."""
    trigger, phrase, other, doc, row, home, at, n = (np.concatenate(x) for x in zip(*(unpack(b, _U8, _U8, _U4, _DOC, _ROW, _AT, _AT, _AT) for b in blobs), strict=True))
    o = np.argsort(trigger)
    t = trigger[o]
    same = t[1:] == t[:-1]
    shared = np.zeros(len(o), bool)
    shared[1:] |= same
    shared[:-1] |= same
    o = o[shared]
    o = o[np.lexsort((doc[o], other[o], phrase[o], trigger[o]))]
    trigger, phrase, other, doc, row, home, at, n = (x[o] for x in (trigger, phrase, other, doc, row, home, at.astype(np.int64), n))
    later, want = np.zeros(len(o), bool), np.zeros(len(o), bool)
    if len(o):
        new_t = np.concatenate([[True], trigger[1:] != trigger[:-1]])
        new_p = new_t | np.concatenate([[True], (phrase[1:] != phrase[:-1]) | (other[1:] != other[:-1])])
        first = doc[new_p]  # of each phrase
        later = doc > first[np.cumsum(new_p) - 1]
        starts = np.flatnonzero(new_t[new_p])  # phrases of a trigger
        many = np.minimum.reduceat(first, starts) < np.maximum.reduceat(first, starts)
        want = many[np.cumsum(new_t) - 1] & ~later
    return (doc[later], row[later], home[later], at[later], at[later] + n[later] + WIDTH - 1), (home[want], trigger[want], doc[want], row[want], at[want], n[want])


class _Texts:
    """Rows of one home by (doc_id, row)."""

    def __init__(self, rows: pa.Table):
        text = rows.column("text").combine_chunks()
        self.data, self.off = as_bytes(text)
        self.ids, self.row = rows.column("doc_id").to_pylist(), rows.column("row").to_pylist()
        self.at: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(self.ids, self.row, strict=True)):
            self.at.setdefault(k, []).append(i)

    def starts(self, doc: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.array([self.off[self.at[k][0]] for k in zip(doc.tolist(), row.tolist(), strict=True)], np.int64)


def _fetch(buckets: int):
    def run(docs: pa.Table, dealt: pa.Table) -> pa.Table:
        made = []
        if docs.num_rows and dealt.num_rows:
            texts = _Texts(docs)
            trigger, doc, row, at, n = (np.concatenate(x) for x in zip(*(unpack(b, _U8, _DOC, _ROW, _AT, _AT) for b in dealt.column("blob").to_pylist()), strict=True))
            start = texts.starts(doc, row) + at
            size = n.astype(np.int64) + WIDTH - 1
            home = dealt.column("to")[0].as_py()
            for k, i in _by(bucket_of(trigger, buckets), buckets):
                raw = texts.data[_flat(start[i], size[i])].tobytes()
                rows = pack((_DOC, doc[i]), (_ROW, row[i]), (_AT, np.full(len(i), home)), (_AT, at[i]), (_AT, n[i]))
                made.append((k, _PHRASES, struct.pack("<I", len(rows)) + rows + zstandard.ZstdCompressor(1).compress(raw)))
        return pa.Table.from_batches(_rows(made), _DEALT_ARROW)

    return run


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … of all ranges in a row."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def suffix_ranks(data: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Equal numbers for positions with WIDTH equal bytes, in suffix order: a suffix array to that depth, by doubling.

    ``at``: positions of which WIDTH bytes lie in one text.  Others end early and get ranks of no use.
    """
    n = len(data)
    wide = np.concatenate([data, np.zeros(7, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key <<= np.uint64(8)
        key |= wide[j : j + n]
    rank, depth = _dense(key), 8
    while depth < WIDTH:
        step = min(depth, WIDTH - depth)
        last = depth + step == WIDTH
        key = rank[at].astype(np.int64) if last else rank.astype(np.int64)
        key *= int(rank.max()) + 1
        after = np.concatenate([rank[step:], np.zeros(step, rank.dtype)])
        key += after[at] if last else after
        del rank, after
        rank = _dense(key)
        depth += step
    return rank


def _dense(key: np.ndarray) -> np.ndarray:
    """The number of each value among the distinct ones in order."""
    kind = np.int32 if len(key) < 1 << 31 else np.int64
    o = np.argsort(key)
    new = np.zeros(len(key), bool)
    ordered = key[o]
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    del ordered
    out = np.empty(len(key), kind)
    out[o] = np.cumsum(new, dtype=kind)
    return out


def _windows(blobs: list[bytes]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of one bucket's dictionary: the ranges of windows that an earlier document's phrase has too."""
    cols, raw = [], []
    for b in blobs:
        (size,) = struct.unpack_from("<I", b)
        cols.append(unpack(b[4 : 4 + size], _DOC, _ROW, _AT, _AT, _AT))
        raw.append(zstandard.ZstdDecompressor().decompress(b[4 + size :]))
    doc, row, home, at, n = (np.concatenate(x) for x in zip(*cols, strict=True))
    data = np.frombuffer(b"".join(raw), np.uint8)
    del raw, cols
    size = n.astype(np.int64) + WIDTH - 1
    off = np.concatenate([[0], np.cumsum(size)])
    p = _flat(off[:-1], n.astype(np.int64))
    rank = suffix_ranks(data, off, p)
    whose = np.repeat(np.arange(len(n)), n)
    docs = doc[whose]
    first = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, rank, docs)
    hit = docs > first[rank]
    i = whose[hit]
    s = at[i].astype(np.int64) + p[hit] - off[i]
    r, s, e = _merged(i, s, s + WIDTH)
    none = np.zeros(0, np.int64)
    return (doc[r], row[r], home[r], s, e), (none,) * 6


def _finish(docs: pa.Table, dealt: pa.Table) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    out = []
    if docs.num_rows:
        texts = _Texts(docs)
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if dealt.num_rows:
            doc, row, s, e = (np.concatenate(x) for x in zip(*(unpack(b, _DOC, _ROW, _AT, _AT) for b in dealt.column("blob").to_pylist()), strict=True))
            first = {k: v[0] for k, v in texts.at.items()}
            r, s, e = _merged(np.array([first[k] for k in zip(doc.tolist(), row.tolist(), strict=True)], np.int64), s.astype(np.int64), e.astype(np.int64))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]])
            ranges = {int(r[a]): (s[a:b], e[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)}
        none = np.zeros(0, np.int64)
        for k, rows in texts.at.items():
            s, e = ranges.get(rows[0], (none, none))
            if k[0] is None:
                s, e = none, none
            for i in rows:
                text = texts.data[texts.off[i] : texts.off[i + 1]].tobytes()
                sha, done = hashlib.sha256(), 0
                for a, b in zip(s.tolist(), e.tolist(), strict=True):
                    sha.update(text[done:a])
                    done = b
                sha.update(text[done:])
                out.append((k[0], len(text), int((e - s).sum()), len(s), sha.hexdigest(), np.stack([s, e], 1).reshape(-1)))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=names)


def deduplicate(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (start, end, start, end, …)."""
    spark = docs.sparkSession
    decode_few(spark)
    n = partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, homes = 4 * n, max(2 * n, size // HOME)
    # no alias that does nothing: the two uses of the dealt texts must look alike for Spark to shuffle them once
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    text, key = F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit("")))
    # `row` tells texts with one doc_id apart
    home = F.pmod(F.xxhash64(F.coalesce(doc_id, key)), F.lit(homes)).cast("int").alias("home")
    docs = docs.select(home, doc_id, key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("row"), text)

    parsed = docs.where("doc_id is not null").mapInArrow(_parse(buckets), _DEALT)
    matched = parsed.repartition(n, "to").sortWithinPartitions("kind", "to").mapInArrow(_grouped(_match), _DEALT)
    files = max(spark.sparkContext.defaultParallelism, size // STORED + 1)
    dealt = stored(matched.coalesce(min(n, files)), "parse")

    at_home = docs.groupBy("home")
    wanted = at_home.cogroup(dealt.where(F.col("kind") == _WANTED).withColumn("home", F.col("to")).groupBy("home")).applyInArrow(_fetch(buckets), _DEALT)
    ends = wanted.repartition(n, "to").sortWithinPartitions("kind", "to").mapInArrow(_grouped(_windows), _DEALT)
    ranges = dealt.where(F.col("kind") == _RANGES).unionByName(ends).withColumn("home", F.col("to"))
    done = at_home.cogroup(ranges.groupBy("home")).applyInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>")
    return done.repartition(min(n, size // HOME + 1))  # small beside the texts: not a file for each home's partition


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return deduplicate(table(spark, sf_dir, "documents")).drop("removed")


#: Every string of 50 bytes by document, the smallest document of each, and the runs of what they cover.
ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, array_slice(b, p + 1, p + 50) AS s FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 49)) AS p FROM d) t),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM w) t WHERE doc_id > first),
part AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS opens FROM hit) t),
span AS (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM part GROUP BY doc_id, run),
total AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans FROM span GROUP BY doc_id),
piece AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS lo, lo AS hi FROM span
  UNION ALL SELECT d.doc_id, coalesce(max(hi), 0), any_value(octet_length(b)) FROM d LEFT JOIN span ON d.doc_id = span.doc_id GROUP BY d.doc_id),
kept AS (SELECT piece.doc_id, string_agg(CASE WHEN piece.hi > piece.lo THEN hex(array_slice(b, piece.lo + 1, piece.hi)) ELSE '' END, '' ORDER BY piece.lo, piece.hi) AS h FROM piece JOIN d ON piece.doc_id = d.doc_id GROUP BY piece.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN total ON d.doc_id = total.doc_id
"""
