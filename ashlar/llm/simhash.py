"""SimHash near-dedup (9): pivot distance tables over fingerprints.

A fingerprint bit is 1 if it is set in over half of the XXH64 values of a text's word shingles.  Equal fingerprints
are one class from the start.  The Hamming distances of each class to ``PIVOTS`` reference fingerprints are computed once
and go with it.  Classes meet in exact buckets (any two fingerprints that differ in at most 3 bits agree in 3 of 6
blocks, so 20 block triples lose no pair).  By the triangle inequality a pair whose rows of the table differ by more
than 3 in any coordinate is discarded, and the survivors are verified.  Members of a bucket are searched from found ones
outwards along the table's first coordinate, so a dense group gives a spanning tree of links rather than its pairs.  A
bucket of over ``LARGE`` classes is not searched but dealt anew by its remaining bits: of four parts of them two near
fingerprints agree in one.

Defined results: null, empty or wordless texts have fingerprint zero and link like any other; fewer words than a
shingle make one shingle of all; repeated rows get equal results; rows with a null doc_id get a fingerprint and the
component of the others with it (null if there is none); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, prepare, table
from .components import components, stored

BITS = 3
SEED = 42
#: Blocks of the 64 bits: (shift, width).
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
TRIPLES = list(combinations(range(6), 3))
PIVOTS = np.random.default_rng(9).integers(0, 2**64, 16, dtype=np.uint64)
#: Shingles hashed at a time, and the sizes of buckets that are searched pair by pair or cut first.
STEP, SMALL, LARGE = 1 << 16, 48, 4096
FOUND = "a long, b long, key long"


def fingerprint(text: bytes, ngram: int) -> int:
    words = text.lower().split()  # bytes: A-Z only, and exactly 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    k = min(ngram, len(words))
    a, b = start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(a), STEP):
        h = np.frombuffer(b"".join([digest(joined[x:y], SEED) for x, y in zip(a[i : i + STEP], b[i : i + STEP], strict=True)]), np.uint8)
        total += np.unpackbits(h.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(a)).tobytes(), "big")


def fingerprints(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long.  One pass, no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((fingerprint(t, ngram) if t else 0 for t in b.column("t").to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fp.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _blocks(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in BLOCKS]


def _keys(fp: Column) -> Column:
    """The 20 bucket keys: the triple's number over the bits of its three blocks."""
    part = _blocks(fp)
    return F.array(*[F.lit(n).cast("long") * F.lit(1 << 33) + part[i] * F.lit(1 << 22) + part[j] * F.lit(1 << 11) + part[k] for n, (i, j, k) in enumerate(TRIPLES)])


def _finer(key: Column, fp: Column) -> Column:
    """Four keys for a member of a large bucket: a part's number and bits, of the bits that its key leaves open."""
    part = _blocks(fp)
    rest = F.array(*[sum((part[b] * F.lit(1 << 11 * p) for p, b in enumerate(sorted(set(range(6)) - set(t)))), F.lit(0).cast("long")) for t in TRIPLES])
    rest = F.element_at(rest, (F.shiftright(key, 33) + 1).cast("int"))
    return F.array(*[(key * F.lit(4) + F.lit(p)) * F.lit(1 << 9) + F.shiftright(rest, 8 * p).bitwiseAND(F.lit(255 if p < 3 else 511)) for p in range(4)])


def pivot_table(fp: Column) -> list[Column]:
    """Distances to the pivots, a byte each, in longs."""
    far = [F.bit_count(fp.bitwiseXOR(F.lit(int(p.view(np.int64))))).cast("long") for p in PIVOTS]
    return [sum((F.shiftleft(d, 8 * i) for i, d in enumerate(far[k : k + 8])), F.lit(0).cast("long")).alias(f"t{k // 8}") for k in range(0, len(PIVOTS), 8)]


def distances(fp: np.ndarray) -> np.ndarray:
    """The table of an array of fingerprints: a row each."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def near(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Of pairs of positions: which are near.  The largest difference of coordinates discards, then distances decide."""
    out = np.zeros(len(i), bool)
    left = np.flatnonzero(np.abs(table[i] - table[j]).max(1, initial=0) <= bits)
    out[left] = np.bitwise_count(fp[i[left]] ^ fp[j[left]]) <= bits
    return out


def spanning(fp: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (positions) that join all members of a bucket that near pairs connect."""
    alive = np.argsort(table[:, 0], kind="stable")
    first = table[:, 0]
    while len(alive):
        reached, alive = [int(alive[0])], alive[1:]
        while reached and len(alive):
            x = reached.pop()
            at = np.arange(*np.searchsorted(first[alive], [first[x] - BITS, first[x] + BITS + 1]))
            at = at[near(fp, table, np.full(len(at), x), alive[at])]
            if len(at):
                found = alive[at]
                reached += found.tolist()
                for y in found.tolist():
                    yield x, y
                alive = np.delete(alive, at)


def _search(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets, sorted by key: columns key, fp, rep and the table."""
    key, fp, rep = rows[0], rows[1].copy().view(np.uint64), rows[2]
    table = np.ascontiguousarray(rows[3:].T).view(np.int8)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    size = np.diff(cut)
    mine = np.repeat(size, size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero((mine > 1) & (mine <= SMALL))
    for d in range(1, min(SMALL, len(small))):
        i, j = small[:-d], small[d:]
        same = key[i] == key[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        ok = near(fp, table, i, j)
        a.append(rep[i[ok]])
        b.append(rep[j[ok]])
    for lo, n in zip(cut[:-1][size > SMALL], size[size > SMALL], strict=True):
        pairs = np.array(list(spanning(fp[lo : lo + n], table[lo : lo + n])), np.int64).reshape(-1, 2)
        a.append(rep[lo + pairs[:, 0]])
        b.append(rep[lo + pairs[:, 1]])
    return np.concatenate(a), np.concatenate(b)


def _link(last: bool):
    """Rows sorted by key to links (a, b); members of large buckets pass as (rep, fp, key), unless this pass is the last."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        open_key, passing = None, 0  # of the bucket at the end of what is held: its rows so far in `held`

        def give(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if rows.shape[1] > 1:
                a, b = _search(rows)
                if len(a):
                    yield pa.record_batch({"a": pa.array(a), "b": pa.array(b), "key": pa.nulls(len(a), pa.int64())})

        def passed(rows: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch({"a": pa.array(rows[2]), "b": pa.array(rows[1]), "key": pa.array(rows[0])})

        for batch in it:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if passing and rows.shape[1]:  # the large bucket that the batch before ended with
                more = int(np.searchsorted(rows[0], open_key, "right"))
                if more:
                    yield passed(rows[:, :more])
                rows = rows[:, more:]
                if not rows.shape[1]:
                    continue
                passing = 0
            held.append(rows)
            if sum(h.shape[1] for h in held) < 1 << 16:
                continue
            rows = np.concatenate(held, 1)
            tail = int(np.searchsorted(rows[0], rows[0, -1], "left"))
            yield from whole(rows[:, :tail], give, passed, last)
            held = [rows[:, tail:]]
            if not last and rows.shape[1] - tail > LARGE:
                yield passed(held[0])
                open_key, passing, held = rows[0, -1], 1, []
        if held:
            yield from whole(np.concatenate(held, 1), give, passed, last)

    def whole(rows: np.ndarray, give, passed, last: bool) -> Iterator[pa.RecordBatch]:
        cut = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [rows.shape[1]]])
        size = np.diff(cut)
        many = np.repeat(size > LARGE, size)
        if last or not many.any():
            yield from give(rows)
            return
        yield passed(rows[:, many])
        yield from give(rows[:, ~many])

    return run


def classes(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of a stored (doc_id, fp) table."""
    spark = prints.sparkSession
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).select("fp", "rep", *pivot_table(F.col("fp"))), "classes")
    table = [c for c in reps.columns if c[0] == "t"]

    def buckets(keyed: DataFrame, last: bool) -> DataFrame:
        return keyed.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_link(last), FOUND)

    found = stored(buckets(reps.where("rep is not null").select(F.explode(_keys(F.col("fp"))).alias("key"), "fp", "rep", *table), False), "found")
    links, large = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", F.col("b").alias("fp"), F.col("a").alias("rep"))
    if not large.isEmpty():
        finer = large.select(F.explode(_finer(F.col("key"), F.col("fp"))).alias("key"), "fp", "rep", *pivot_table(F.col("fp")))
        links = links.unionByName(buckets(finer, True).select("a", "b"))
    joined = components(links)
    return reps.join(joined, reps.rep == joined.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """A row per document: doc_id, fingerprint (hex), component_id (the smallest doc_id that links reach)."""
    prints = stored(fingerprints(docs, ngram), "fingerprints")
    # a fingerprint that many rows share is split by adaptive execution: these rows are two longs each
    return prints.join(classes(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


#: XXH64 in 128-bit arithmetic: whole stripes of 32 bytes in four lanes, then words of 8, one of 4, single bytes.
_M = "18446744073709551615::UHUGEINT"
_P1, _P2, _P3, _P4, _P5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: str, n: int) -> str:
    return f"((({x}) << {n}) & {_M} | (({x}) >> {64 - n}))"


def _times(x: str, p: str) -> str:
    return f"((({x}) * {p}) & {_M})"


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(array_slice(w, i, i + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0) t),
u AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM g) t),
l AS (SELECT s, n, n // 32 AS stripes, list_transform(range(n // 8), lambda i: ('0x' || substr(x, 16 * i + 15, 2) || substr(x, 16 * i + 13, 2) || substr(x, 16 * i + 11, 2) || substr(x, 16 * i + 9, 2) || substr(x, 16 * i + 7, 2) || substr(x, 16 * i + 5, 2) || substr(x, 16 * i + 3, 2) || substr(x, 16 * i + 1, 2))::UBIGINT::UHUGEINT) AS q,
  CASE WHEN n % 8 >= 4 THEN ('0x' || substr(x, 16 * (n // 8) + 7, 2) || substr(x, 16 * (n // 8) + 5, 2) || substr(x, 16 * (n // 8) + 3, 2) || substr(x, 16 * (n // 8) + 1, 2))::UBIGINT::UHUGEINT END AS four,
  list_transform(range(n - n % 4, n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT::UHUGEINT) AS ones FROM u),
v AS (SELECT *, list_transform([{{'z': (42::UHUGEINT + {_P1} + {_P2}) & {_M}, 'k': 1}}, {{'z': (42::UHUGEINT + {_P2}) & {_M}, 'k': 2}}, {{'z': 42::UHUGEINT, 'k': 3}}, {{'z': (42::UHUGEINT + {_M} + 1::UHUGEINT - {_P1}) & {_M}, 'k': 4}}],
  lambda a: list_reduce(list_prepend(a.z, list_transform(range(stripes), lambda j: q[4 * j + a.k])), lambda z, x: {_times(_rot(f"((z + {_times('x', _P2)}) & {_M})", 31), _P1)})) AS lanes FROM l),
m AS (SELECT *, CASE WHEN stripes = 0 THEN (42::UHUGEINT + {_P5}) & {_M} ELSE list_reduce(list_prepend(({_rot('lanes[1]', 1)} + {_rot('lanes[2]', 7)} + {_rot('lanes[3]', 12)} + {_rot('lanes[4]', 18)}) & {_M}, lanes), lambda h, z: ({_times(f"xor(h, {_times(_rot(_times('z', _P2), 31), _P1)})", _P1)} + {_P4}) & {_M}) END AS h0 FROM v),
m1 AS (SELECT *, list_reduce(list_prepend((h0 + n::UHUGEINT) & {_M}, array_slice(q, 4 * stripes + 1, len(q))), lambda h, k: ({_times(_rot(f"xor(h, {_times(_rot(_times('k', _P2), 31), _P1)})", 27), _P1)} + {_P4}) & {_M}) AS h1 FROM m),
m2 AS (SELECT *, CASE WHEN four IS NULL THEN h1 ELSE ({_times(_rot(f"xor(h1, {_times('four', _P1)})", 23), _P2)} + {_P3}) & {_M} END AS h2 FROM m1),
m3 AS (SELECT *, list_reduce(list_prepend(h2, ones), lambda h, k: {_times(_rot(f"xor(h, {_times('k', _P5)})", 11), _P1)}) AS h3 FROM m2),
m4 AS (SELECT s, {_times('xor(h3, h3 >> 33)', _P2)} AS h4 FROM m3), m5 AS (SELECT s, {_times('xor(h4, h4 >> 29)', _P3)} AS h5 FROM m4), m6 AS (SELECT s, xor(h5, h5 >> 32)::UBIGINT AS h FROM m5),
bits AS (SELECT doc_id, count(*) AS n, {", ".join(f"sum((h >> {b}) & 1) AS b{b}" for b in range(64))} FROM g JOIN m6 USING (s) GROUP BY doc_id),
fp AS (SELECT d.doc_id, coalesce({" + ".join(f"(CASE WHEN 2 * b{b} > n THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64))}, 0::UBIGINT) AS f FROM d LEFT JOIN bits ON d.doc_id = bits.doc_id),
c AS (SELECT f, min(doc_id) AS r FROM fp GROUP BY f),
e AS (SELECT a.r AS a, b.r AS b FROM c a, c b WHERE bit_count(xor(a.f, b.f)) <= 3),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT fp.doc_id, lower(lpad(to_hex(fp.f), 16, '0')) AS fingerprint, low AS component_id FROM fp JOIN c ON fp.f = c.f JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) t ON t.a = c.r
"""
