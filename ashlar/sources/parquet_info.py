"""What Parquet files say of themselves: row groups, columns, encodings, codecs, offsets.  Footers only, on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from ashlar.sources import fs

CHUNKS = "file string, row_group int, column string, physical_type string, codec string, encodings array<string>, dictionary_offset long, data_offset long, compressed_bytes long, rows long, nulls long"


def files(spark: SparkSession, path: str) -> list[str]:
    """A file, or the Parquet files of a folder."""
    if not fs.is_folder(spark, path):
        return [path]
    return [f"{path.rstrip('/')}/{n}" for n in fs.names(spark, path) if n.endswith(".parquet") and n[0] not in "._"]


def footer(spark: SparkSession, path: str) -> pq.FileMetaData:
    with fs.Opened(spark, path) as f:
        return pq.read_metadata(pa.PythonFile(f, "r"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """A row per column chunk of the files."""

    def rows() -> Iterator[tuple]:
        for file in files(spark, path):
            m = footer(spark, file)
            for g in range(m.num_row_groups):
                for c in range(m.num_columns):
                    x = m.row_group(g).column(c)
                    s = x.statistics
                    yield (file.rpartition("/")[2], g, x.path_in_schema, x.physical_type, x.compression, sorted(x.encodings), x.dictionary_page_offset, x.data_page_offset, x.total_compressed_size, m.row_group(g).num_rows, s.null_count if s is not None and s.has_null_count else None)

    return spark.createDataFrame(list(rows()), CHUNKS)
