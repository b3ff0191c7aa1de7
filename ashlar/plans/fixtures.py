"""Writers of the sources that the registered queries read: Iceberg tables, Avro files, folders, Parquet of every kind.

Data files are written by Spark; Avro and metadata files, which are small, by the driver.  All lie in fresh folders below
the one that driver and executors share.
"""

from __future__ import annotations

import json
import struct
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.sources import fs

_SYNC = bytes(range(200, 216))


def _long(n: int) -> bytes:
    n = n << 1 ^ n >> 63
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _value(schema, v, names: dict) -> bytes:
    if isinstance(schema, list):
        i = next(i for i, s in enumerate(schema) if (s == "null") == (v is None))
        return _long(i) + _value(schema[i], v, names)
    schema = names.get(schema, schema) if isinstance(schema, str) else schema
    kind = schema if isinstance(schema, str) else schema["type"]
    if isinstance(schema, dict) and "name" in schema:
        names[schema["name"]] = schema
    if kind == "record":
        return b"".join(_value(f["type"], v[f["name"]], names) for f in schema["fields"])
    if kind == "array":
        return (_long(len(v)) + b"".join(_value(schema["items"], x, names) for x in v) if v else b"") + b"\0"
    if isinstance(kind, dict):
        return _value(kind, v, names)
    if kind in ("int", "long"):
        return _long(v)
    if kind in ("string", "bytes"):
        raw = v.encode() if isinstance(v, str) else v
        return _long(len(raw)) + raw
    if kind == "double":
        return struct.pack("<d", v)
    if kind == "boolean":
        return bytes([v])
    return b""


def avro_container(schema: dict, rows: list[dict], per: int = 10) -> bytes:
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"null"}
    out = [b"Obj\x01", _long(len(meta)), *[_value("string", k, {}) + _value("bytes", v, {}) for k, v in meta.items()], b"\0", _SYNC]
    for i in range(0, len(rows), per):
        part = rows[i : i + per]
        block = b"".join(_value(schema, r, {}) for r in part)
        out += [_long(len(part)), _long(len(block)), block, _SYNC]
    return b"".join(out)


def avro_folder(spark: SparkSession, sf_dir: str) -> str:
    """nation as two Avro files; comment is null for every third."""
    nation = sorted(spark.read.parquet(f"{sf_dir}/nation.parquet").collect())  # a table of fixed size
    schema = {"type": "record", "name": "nation", "fields": [{"name": "n_nationkey", "type": "int"}, {"name": "n_name", "type": "string"}, {"name": "n_regionkey", "type": ["null", "int"]}, {"name": "share", "type": "double"}, {"name": "even", "type": "boolean"}, {"name": "comment", "type": ["null", "string"]}]}
    rows = [{"n_nationkey": r.n_nationkey, "n_name": r.n_name, "n_regionkey": r.n_regionkey, "share": r.n_nationkey / 8, "even": r.n_nationkey % 2 == 0, "comment": None if r.n_nationkey % 3 == 0 else r.n_name.lower()} for r in nation]
    folder = fs.shared_folder(spark, "nation") + ".avro"
    for i in range(2):
        fs.write(spark, f"{folder}/part-{i}.avro", avro_container(schema, rows[i::2], per=4))
    return folder


def _file(df: DataFrame, path: str, **options: str) -> None:
    """The rows as one file at that path."""
    spark = df.sparkSession
    made = fs.shared_folder(spark, "file")
    df.coalesce(1).write.options(**options).parquet(made)
    part = next(n for n in fs.names(spark, made) if n.startswith("part-"))
    fs.move(spark, f"{made}/{part}", path)
    fs.delete(spark, made)


def split_folder(spark: SparkSession, sf_dir: str) -> str:
    """supplier: even keys in data/, odd ones in the folder itself, and a file that is no Parquet beside them."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    folder = fs.shared_folder(spark, "supplier")
    _file(supplier.where("s_suppkey % 2 = 0"), f"{folder}/data/a.parquet")
    _file(supplier.where("s_suppkey % 2 = 1"), f"{folder}/b.parquet")
    fs.write(spark, f"{folder}/notes.txt", b"no data\n")
    return folder


def encoded_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """supplier with decimals, flags and nested columns, by format version and codec."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    rows = supplier.select(
        "s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey")).alias("s_nationkey"), F.col("s_acctbal").cast("decimal(30,2)").alias("balance"), (F.col("s_acctbal") > 0).alias("owed"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array()).when(F.col("s_suppkey") % 3 == 1, F.array("s_suppkey", F.lit(None), "s_nationkey")).alias("keys"),
    )
    folder, out = fs.shared_folder(spark, "encoded"), {}
    for version, codec in (("v1", "uncompressed"), ("v1", "snappy"), ("v2", "gzip"), ("v2", "zstd"), ("v2", "lz4_raw")):
        out[f"{version} {codec}"] = path = f"{folder}/{version}-{codec}.parquet"
        _file(rows, path, **{"compression": codec, "parquet.writer.version": version, "parquet.enable.dictionary": str(version == "v1").lower(), "parquet.page.size": "2048"})
    return out


def one_row_group(spark: SparkSession, sf_dir: str) -> str:
    """orders as one file of one row group, however many files and row groups the table has.

    The task that writes it holds the row group, encoded and compressed, until its end.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    path = f"{fs.shared_folder(spark, 'summary')}/orders.parquet"
    if orders.isEmpty():  # of no rows Spark makes no row group, Arrow one
        out = pa.BufferOutputStream()
        pq.write_table(orders.toArrow(), out)
        fs.write(spark, path, out.getvalue().to_pybytes())
    else:
        _file(orders, path, **{"parquet.block.size": str(1 << 32)})
    return path


_KV = {"type": "record", "name": "kv", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}
_BOUNDS = ["null", {"type": "array", "items": _KV}]
_DATA_FILE = {"type": "record", "name": "data_file", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"}, {"name": "file_size_in_bytes", "type": "long"}, {"name": "lower_bounds", "type": _BOUNDS}, {"name": "upper_bounds", "type": ["null", {"type": "array", "items": "kv"}]}]}
_ENTRY = {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": ["null", "long"]}, {"name": "sequence_number", "type": ["null", "long"]}, {"name": "file_sequence_number", "type": ["null", "long"]}, {"name": "data_file", "type": _DATA_FILE}]}
_LISTED = {"type": "record", "name": "listed", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "content", "type": "int"}, {"name": "sequence_number", "type": "long"}, {"name": "added_snapshot_id", "type": "long"}]}


def iceberg_table(spark: SparkSession, sf_dir: str, how: str = "full") -> str:
    """orders in four files by a fourth of the keys, the last one deleted again.

    full: manifests in Avro; the first file was written before o_totalprice got its name and o_orderpriority came.
    one_level: the list holds the data files.  json: the list is JSON and names them; files have no ids.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"), "o_orderpriority")
    kinds = {"o_orderkey": "long", "o_custkey": "long", "o_orderstatus": "string", "o_totalprice": "decimal(12,2)", "o_orderpriority": "string"}
    ids = {c: 11 + i for i, c in enumerate(kinds)}
    root = fs.shared_folder(spark, "orders")
    entries = []
    for part in range(4):
        rows = orders.where(F.pmod("o_orderkey", F.lit(4)) == part)
        lo, hi, n = rows.agg(F.min("o_totalprice"), F.max("o_totalprice"), F.count("*")).first()
        named = [F.col(c).alias("price" if part == 0 and c == "o_totalprice" else c, metadata={"parquet.field.id": ids[c]}) for c in kinds if part or c != "o_orderpriority"]
        path = f"{root}/data/part-{part}.parquet"
        _file(rows if how == "json" else rows.select(*named), path)
        bound = lambda x: [{"key": ids["o_totalprice"], "value": int(Decimal(x).scaleb(2)).to_bytes(8, "big", signed=True)}] if x is not None else None
        status = (0, 1, 1, 2)[part]
        entries.append({"status": status, "snapshot_id": 1 if part == 0 else None, "sequence_number": 1 if part == 0 else None, "file_sequence_number": 1 if part == 0 else None, "data_file": {"content": 0, "file_path": f"/old/place/orders/data/part-{part}.parquet", "file_format": "PARQUET", "record_count": n, "file_size_in_bytes": 0, "lower_bounds": bound(lo), "upper_bounds": bound(hi)}})
    meta = f"{root}/metadata"
    if how == "json":
        fs.write(spark, f"{meta}/list.avro", json.dumps([{"manifest_path": f"orders\\data/part-{i}.parquet", "added_rows_count": entries[i]["data_file"]["record_count"]} for i in range(3)]).encode())
    elif how == "one_level":
        fs.write(spark, f"{meta}/list.avro", avro_container(_ENTRY, entries))
    else:
        fs.write(spark, f"{meta}/m0.avro", avro_container(_ENTRY, entries[:2]))
        fs.write(spark, f"{meta}/m1.avro", avro_container(_ENTRY, entries[2:]))
        fs.write(spark, f"{meta}/list.avro", avro_container(_LISTED, [{"manifest_path": f"file:/old/place/orders/metadata/m{i}.avro", "content": 0, "sequence_number": 2, "added_snapshot_id": 7} for i in range(2)]))
    fields = [{"id": ids[c], "name": c, "required": False, "type": t} for c, t in kinds.items()]
    fs.write(spark, f"{meta}/v1.metadata.json", b"{}")
    fs.write(spark, f"{meta}/v3.metadata.json", json.dumps({"format-version": 2, "location": "file:///old/place/orders", "current-schema-id": 1, "schemas": [{"schema-id": 0, "fields": fields[:3]}, {"schema-id": 1, "fields": fields}], "current-snapshot-id": 7, "snapshots": [{"snapshot-id": 1, "manifest-list": "gone.avro"}, {"snapshot-id": 7, "manifest-list": "/old/place/orders/metadata/list.avro"}]}).encode())
    return root
