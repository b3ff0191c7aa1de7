"""Which source a path is, and the DataFrame over it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ashlar.errors import SourceError
from ashlar.sources import avro, fs, iceberg


def kind_of(spark: SparkSession, path: str) -> str:
    """iceberg, avro, parquet, orc, csv or json: by extension, then by a metadata folder, then by a file's first bytes."""
    extension = path.rstrip("/").rpartition(".")[2].lower()
    if extension in ("parquet", "avro", "orc", "csv", "json"):
        return extension
    if re.match("https?://", path):
        raise SourceError(f"{path}: files are read through Hadoop's file systems, not over HTTP")
    if fs.is_folder(spark, path):
        return "iceberg" if fs.is_folder(spark, f"{path.rstrip('/')}/metadata") else "parquet"
    if fs.exists(spark, path):
        head = fs.read(spark, path, 4)
        if head in (b"PAR1", avro.MAGIC):
            return "parquet" if head == b"PAR1" else "avro"
        if head[:3] == b"ORC":
            return "orc"
    raise SourceError(f"cannot tell what {path} is, or it is not there")


def exists(spark: SparkSession, path: str) -> bool:
    return fs.exists(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    kind = kind_of(spark, path)
    if not exists(spark, path):
        raise SourceError(f"no such file: {path}")
    if kind == "iceberg":
        return iceberg.read_iceberg(spark, path)
    if kind == "avro":
        return avro.read_avro(spark, path)
    if kind == "parquet":
        return spark.read.parquet(*_parquet_files(spark, path))
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.format(kind).load(path)


def _parquet_files(spark: SparkSession, path: str) -> list[str]:
    """A folder's data/*.parquet and then its own *.parquet where the former is there; Spark lists everything else itself."""
    top = path.rstrip("/")
    if not any(n.endswith(".parquet") for n in fs.names(spark, f"{top}/data")):
        return [path]
    own = any(n.endswith(".parquet") for n in fs.names(spark, top))
    return [f"{top}/data/*.parquet", *([f"{top}/*.parquet"] if own else [])]
