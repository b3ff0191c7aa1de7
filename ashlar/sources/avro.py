"""Avro containers: decoded by their own schema; no jar is needed.

Files of up to ``SPLIT`` bytes are cells of Spark's binary source.  Larger ones are cut at their sync marker by its text
source, which splits a file among tasks, so no cell is larger than a block and no file is bound to one task.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashlar.errors import FormatError, UnsupportedError
from ashlar.shipping import ship
from ashlar.sources import fs

MAGIC = b"Obj\x01"
SPLIT = 64 << 20
_PRIMITIVE = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError("an Avro value goes beyond the end of its block")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return value >> 1 ^ -(value & 1)
            shift += 7
            if shift > 63:
                raise FormatError("an Avro number has too many bytes")

    def bytes(self) -> bytes:
        return self.take(self.long())


def _blocks(cur: Cursor) -> Iterator[int]:
    """Counts of the blocks of an array or map; a negative one is followed by the block's size."""
    while n := cur.long():
        if n < 0:
            n = -n
            cur.long()
        yield n


def reader(schema, names: dict | None = None) -> Callable[[Cursor], object]:
    """A function that reads a value written with the schema."""
    names = {} if names is None else names
    if isinstance(schema, str) and schema in names:
        return lambda c: names[schema](c)  # looked up late: a record may hold itself
    if isinstance(schema, list):
        branches = [reader(s, names) for s in schema]

        def union(c: Cursor):
            i = c.long()
            if not 0 <= i < len(branches):
                raise FormatError(f"no branch {i} in a union of {len(branches)}")
            return branches[i](c)

        return union
    kind = schema if isinstance(schema, str) else schema["type"]
    logical = None if isinstance(schema, str) else schema.get("logicalType")
    if isinstance(kind, (dict, list)):
        return reader(kind, names)
    if kind in ("int", "long"):
        if logical == "date":
            return lambda c: date(1970, 1, 1) + timedelta(days=c.long())
        if logical in ("timestamp-millis", "timestamp-micros"):
            unit = 1000 if logical.endswith("millis") else 1
            return lambda c: _EPOCH + timedelta(microseconds=c.long() * unit)
        return lambda c: c.long()
    if kind in ("bytes", "fixed"):
        size = schema["size"] if kind == "fixed" else None
        raw = (lambda c: c.take(size)) if kind == "fixed" else (lambda c: c.bytes())
        out = raw
        if logical == "decimal":
            scale = schema.get("scale", 0)
            out = lambda c: Decimal(int.from_bytes(raw(c), "big", signed=True)).scaleb(-scale)
        if kind == "fixed":
            _name(schema, names, out)
        return out
    if kind == "null":
        return lambda c: None
    if kind == "boolean":
        return lambda c: c.take(1) != b"\0"
    if kind == "float":
        return lambda c: struct.unpack("<f", c.take(4))[0]
    if kind == "double":
        return lambda c: struct.unpack("<d", c.take(8))[0]
    if kind == "string":
        return lambda c: c.bytes().decode()
    if kind == "enum":
        symbols = schema["symbols"]
        out = lambda c: symbols[c.long()]
        _name(schema, names, out)
        return out
    if kind == "array":
        item = reader(schema["items"], names)
        return lambda c: [item(c) for n in _blocks(c) for _ in range(n)]
    if kind == "map":
        value = reader(schema["values"], names)
        return lambda c: {c.bytes().decode(): value(c) for n in _blocks(c) for _ in range(n)}
    if kind == "record":
        fields: list = []

        def record(c: Cursor):
            return {k: f(c) for k, f in fields}

        _name(schema, names, record)
        fields += [(f["name"], reader(f["type"], names)) for f in schema["fields"]]
        return record
    raise UnsupportedError(f"Avro type {kind!r}")


def _name(schema: dict, names: dict, fn: Callable) -> None:
    names[schema["name"]] = fn
    if schema.get("namespace"):
        names[f"{schema['namespace']}.{schema['name']}"] = fn


def header(data: bytes) -> tuple[dict, str, bytes, int]:
    """(schema, codec, sync marker, where the blocks begin)."""
    if data[:4] != MAGIC:
        raise FormatError("not an Avro container")
    cur = Cursor(data, 4)
    meta = {}
    for n in _blocks(cur):
        for _ in range(n):
            k = cur.bytes().decode()
            meta[k] = cur.bytes()
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), cur.take(16), cur.at


def records(data: bytes) -> Iterator[dict]:
    """All records of a container; sync markers are checked."""
    schema, codec, sync, at = header(data)
    read, cur = reader(schema), Cursor(data, at)
    while cur.at < len(data):
        n, block = cur.long(), cur.bytes()
        if cur.take(16) != sync:
            raise FormatError("an Avro block does not end with the sync marker")
        yield from _records_of(n, block, codec, read)


def _records_of(n: int, block: bytes, codec: str, read: Callable[[Cursor], object]) -> Iterator[dict]:
    if codec == "deflate":
        block = zlib.decompress(block, -15)
    elif codec == "zstandard":
        import zstandard

        block = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(block)).read()
    elif codec == "snappy":
        block = pa.decompress(block[:-4], _snappy_size(block), "snappy").to_pybytes()
    elif codec != "null":
        raise UnsupportedError(f"Avro codec {codec!r}")
    inner = Cursor(block)
    for _ in range(n):
        yield read(inner)


def _between_markers(part: bytes, codec: str, read: Callable[[Cursor], object]) -> Iterator[dict]:
    """The records of what stands between two sync markers: the file's head has none."""
    if part[:4] == MAGIC:
        return
    cur = Cursor(part)
    n, block = cur.long(), cur.bytes()
    if cur.at != len(part):
        raise FormatError("an Avro block does not end with the sync marker")
    yield from _records_of(n, block, codec, read)


def _snappy_size(block: bytes) -> int:
    size = shift = 0
    for b in block:
        size |= (b & 127) << shift
        shift += 7
        if b < 128:
            break
    return size


def spark_type(schema, names: dict | None = None) -> T.DataType:
    names = {} if names is None else names
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        if len(rest) == 1:
            return spark_type(rest[0], names)
        if set(map(str, rest)) == {"int", "long"}:
            return T.LongType()
        if not rest:
            return T.NullType()
        raise UnsupportedError(f"an Avro union of {rest}")
    if isinstance(schema, str):
        if schema in names:
            return names[schema]
        return _PRIMITIVE[schema]
    kind, logical = schema["type"], schema.get("logicalType")
    if isinstance(kind, (dict, list)):
        return spark_type(kind, names)
    if kind == "record":
        out = T.StructType([T.StructField(f["name"], spark_type(f["type"], names)) for f in schema["fields"]])
    elif kind == "array":
        return T.ArrayType(spark_type(schema["items"], names))
    elif kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"], names))
    elif kind == "enum":
        out = T.StringType()
    elif logical == "decimal":
        out = T.DecimalType(schema["precision"], schema.get("scale", 0))
    elif kind == "fixed":
        out = T.BinaryType()
    elif logical == "date":
        return T.DateType()
    elif logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    else:
        return spark_type(kind, names)
    if "name" in schema:
        _name(schema, names, out)
    return out


def _decoded(cells: DataFrame, of: Callable[[bytes], Iterator], schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in it:
            for cell in b.column(0):
                for r in of(cell.as_py()):
                    rows.append(r if isinstance(r, dict) else {"value": r})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return cells.mapInArrow(run, schema)


def read_avro(spark: SparkSession, *paths: str) -> DataFrame:
    """A DataFrame over Avro files, folders or patterns; any file system that Spark reads."""
    ship(spark)
    files = spark.read.format("binaryFile").load(list(paths))
    large = [r.path for r in files.where(F.col("length") > SPLIT).select("path").collect()]  # names alone are read
    first = files.select("path").first()
    if first is None:
        raise FormatError(f"no Avro file in {', '.join(paths)}")
    schema = spark_type(_head(spark, first.path)[0])
    if not isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField("value", schema)])
    out = _decoded(files.where(F.col("length") <= SPLIT).select("content"), records, schema)
    for path in large:
        own, codec, sync, _ = _head(spark, path)
        # bytes pass the text source as they are; the marker is given in a character set that has them all
        parts = spark.read.format("text").options(encoding="ISO-8859-1", lineSep=sync.decode("latin-1")).load(path).select(F.col("value").cast("binary"))
        out = out.unionByName(_decoded(parts, _of_blocks(own, codec), schema))
    return out


def _of_blocks(schema, codec: str) -> Callable[[bytes], Iterator]:
    made: list = []  # in the worker: readers hold closures over themselves

    def of(part: bytes) -> Iterator:
        if not made:
            made.append(reader(schema))
        return _between_markers(part, codec, made[0])

    return of


def _head(spark: SparkSession, path: str) -> tuple[dict, str, bytes, int]:
    most = 1 << 16
    while True:
        data = fs.read(spark, path, most)
        try:
            return header(data)
        except FormatError:
            if len(data) < most or data[:4] != MAGIC:
                raise
            most *= 16
