"""Files on the driver through Hadoop's file systems: the same for a local path and for any store that Spark reads."""

from __future__ import annotations

import io
import tempfile
import uuid

from pyspark.sql import SparkSession

from ashlar.errors import SourceError


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read(spark: SparkSession, path: str, most: int | None = None) -> bytes:
    """A file's first bytes, all of them by default: for heads and metadata, not for data."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        raise SourceError(f"no such file: {path}")
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes() if most is None else stream.readNBytes(most))
    finally:
        stream.close()


def write(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _at(spark, path)
    q = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise SourceError(f"cannot move {path} to {to}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


class Opened(io.RawIOBase):
    """A file for libraries that read here and there, such as a Parquet footer."""

    def __init__(self, spark: SparkSession, path: str):
        fs, p = _at(spark, path)
        if not fs.exists(p):
            raise SourceError(f"no such file: {path}")
        self._stream, self._size, self._pos = fs.open(p), fs.getFileStatus(p).getLen(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._pos

    def seek(self, offset: int, whence: int = 0) -> int:
        self._pos = offset + (0, self._pos, self._size)[whence]
        return self._pos

    def read(self, n: int = -1) -> bytes:
        n = self._size - self._pos if n is None or n < 0 else min(n, self._size - self._pos)
        self._stream.seek(self._pos)
        out = bytes(self._stream.readNBytes(n))
        self._pos += len(out)
        return out

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set by hand.

    Where neither is set, a temporary folder serves if all runs in one process, as in tests; on a cluster it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise SourceError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ashlar-"))
        top = spark.sparkContext.getCheckpointDir()
    return top.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path there."""
    return f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"
