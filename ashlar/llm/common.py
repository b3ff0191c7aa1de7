"""What the operators share: session settings, the shared folder, vectorised text helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.shipping import ship
from ashlar.sources import fs

#: Bytes of one Arrow batch between the JVM and Python, unless the session says otherwise: batches of long texts have few rows.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20
#: Rows of a table that the JVM decodes at a time, unless the session says otherwise: each may be a long text, and a JVM's
#: heap grows in jumps where many arrays are of half a megabyte or more.
DECODED, DECODED_ROWS = "spark.sql.parquet.columnarReaderBatchSize", 256


def prepare(spark: SparkSession) -> None:
    """The package for the workers, a bound for Arrow batches where none is set, and the shared folder, or an error without one."""
    ship(spark)
    if spark.conf.get(BATCH, None) in (None, "", str(2**31 - 1), f"{2**31 - 1}b"):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    fs.shared_top(spark)


def decode_few(spark: SparkSession) -> None:
    """``DECODED_ROWS`` where the session has Spark's default."""
    if spark.conf.get(DECODED, None) in (None, "", "4096"):
        spark.conf.set(DECODED, str(DECODED_ROWS))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    prepare(spark)
    return fs.shared_folder(spark, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fresh(names: list[str], name: str) -> str:
    """A column name that none of ``names`` is."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def row_key(*cols: str) -> Column:
    """Tells rows with one id but different contents apart."""
    return F.xxhash64(*cols)


# ---------------------------------------------------------------- byte arrays of a batch


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def groups_of(off: np.ndarray, limit: int, rows: int = 1 << 20) -> list[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes and at most so many rows, one document at least."""
    out, a = [], 0
    while a < len(off) - 1:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), a + rows)
        out.append((a, b))
        a = b
    return out


_RNG = np.random.default_rng(20240607)
BYTE, OTHER = (_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
BASE = np.uint64(0x9E3779B97F4A7C15)
INV = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i < n (kept for the next call up to 4 Mi)."""
    if len(_POWERS[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        made = []
        for b in (BASE, INV):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        if size > 1 << 22:
            return made[0][:n], made[1][:n]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


class RangeHash:
    """64-bit polynomial hash of any byte range of one buffer, by prefix sums.  Two with different ``byte`` values make 128 bits."""

    def __init__(self, data: np.ndarray, byte: np.ndarray = BYTE):
        n = len(data)
        p, self.inv = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[data] * p[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))

    def rolling(self, k: int) -> np.ndarray:
        """Hash of every k bytes, by start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes other than 0x20 and 0x09-0x0D."""
    inside = ~SPACE[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags by document."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]
