"""Iceberg tables (v1, v2 without deletes): metadata and manifests on the driver, live files to Spark's Parquet reader.

Files are pruned by the manifests' bounds before the plan is made, decoded by each field's declared type; within
files Spark's own pushdown goes on.  Columns are found by field id, so renamed and added ones are right in files of any
age; files without ids are read by name.  Everything goes through Hadoop's file systems, so a table may lie anywhere.
"""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ashlar.errors import FormatError, SourceError, UnsupportedError
from ashlar.sources import avro, fs, parquet_info

_TYPES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "time": T.LongType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "uuid": T.StringType(), "binary": T.BinaryType()}
_EXISTING, _ADDED, _DELETED = 0, 1, 2
#: Under which Spark's Parquet reader looks for a column's id.
FIELD_ID = "parquet.field.id"
Conjunct = tuple[str, str, object]  # ("age", ">", 25)


@dataclass
class DataFile:
    path: str
    records: int
    lower: dict[int, bytes] = field(default_factory=dict)
    upper: dict[int, bytes] = field(default_factory=dict)
    status: int = _ADDED
    content: int = 0
    sequence: int | None = None
    file_sequence: int | None = None
    snapshot: int | None = None
    size: int | None = None


def spark_type(t, ids: bool = False) -> T.DataType:
    """ids: fields of structs carry their field ids."""
    if isinstance(t, dict):
        if t["type"] == "struct":
            return T.StructType([T.StructField(f["name"], spark_type(f["type"], ids), not f.get("required", False), {FIELD_ID: f["id"]} if ids else None) for f in t["fields"]])
        if t["type"] == "list":
            return T.ArrayType(spark_type(t["element"], ids), not t.get("element-required", False))
        if t["type"] == "map":
            return T.MapType(spark_type(t["key"], ids), spark_type(t["value"], ids), not t.get("value-required", False))
    elif t in _TYPES:
        return _TYPES[t]
    elif m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", t):
        return T.DecimalType(int(m[1]), int(m[2]))
    elif re.fullmatch(r"fixed\[\d+\]", t):
        return T.BinaryType()
    raise UnsupportedError(f"Iceberg type {t!r}")


class IcebergTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._places: dict[str, int] = {}
        self.metadata = json.loads(self._bytes(self._newest()))
        schemas = self.metadata.get("schemas") or [self.metadata["schema"]]
        current = self.metadata.get("current-schema-id", schemas[0].get("schema-id", 0))
        self.fields = next((s for s in schemas if s.get("schema-id", 0) == current), schemas[-1])["fields"]
        self.schema = T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in self.fields])

    def _bytes(self, path: str) -> bytes:
        return fs.read(self.spark, path)

    def _newest(self) -> str:
        """vN.metadata.json of the largest N, or N-….metadata.json."""
        folder = f"{self.path}/metadata"
        found = [(int(m[1]), n) for n in fs.names(self.spark, folder) if (m := re.fullmatch(r"v?(\d+)(?:-.*)?\.metadata\.json", n))]
        if not found:
            raise SourceError(f"no Iceberg metadata in {folder}")
        return f"{folder}/{max(found)[1]}"

    def _local(self, name: str) -> str:
        """A path of the metadata where the table lies now: back slashes, file:, drives and the old location are seen through."""
        name = name.replace("\\", "/")
        bare = re.sub(r"^file:/*(?=[A-Za-z]:/)|^file:(?=/)", "", name)
        bare = re.sub(r"^//+", "/", bare)
        location = re.sub(r"^file:/*(?=/)", "", str(self.metadata.get("location", "")).replace("\\", "/")).rstrip("/")
        tries = [bare] if "://" not in self.path and "://" not in bare else []
        if location and bare.startswith(location + "/"):
            tries.insert(0, f"{self.path}{bare[len(location) :]}")
        for part in ("/metadata/", "/data/"):
            if part in f"/{bare}":
                tries.append(self.path + part + f"/{bare}".rpartition(part)[2])
        tries.append(f"{self.path}/{bare.lstrip('/')}")
        if "://" in name and not name.startswith("file:"):
            tries.append(name)
        # one look for a folder of files: where the first lies, the others do
        kind = bare.rpartition("/")[0]
        if kind in self._places:
            return tries[self._places[kind]]
        for i, p in enumerate(tries):
            if fs.exists(self.spark, p):
                self._places[kind] = i
                return p
        raise SourceError(f"{name} is named by the table's metadata but is not there")

    def snapshot(self) -> dict | None:
        want = self.metadata.get("current-snapshot-id")
        if want is None or want == -1:
            return None
        return next((s for s in self.metadata.get("snapshots") or [] if s["snapshot-id"] == want), None)

    def files(self) -> list[DataFile]:
        """Live data files of the current snapshot."""
        out = []
        for f in self.entries():
            if f.status == _DELETED:
                continue
            if f.content:
                raise UnsupportedError(f"{f.path} is a delete file")
            out.append(f)
        return out

    def entries(self) -> list[DataFile]:
        """Every entry of the current snapshot's manifests: added, existing and deleted, data and delete files."""
        snap = self.snapshot()
        if snap is None:
            return []
        if "manifest-list" not in snap:
            return [f for m in snap.get("manifests", []) for f in self._manifest(self._entries(m), {})]
        out = []
        for e in self._entries(snap["manifest-list"]):
            if "manifest_path" not in e:  # one level: the list holds data files
                out += self._manifest([e], {})
                continue
            path = e["manifest_path"]
            if path.endswith(".parquet"):  # a list in JSON that names data files
                out.append(DataFile(self._local(path), int(e.get("added_rows_count") or 0)))
                continue
            out += self._manifest(self._entries(path), e)
        return out

    def summary(self) -> DataFrame:
        """A row per entry: file, status, content, records, size, data and file sequence numbers, snapshot."""
        rows = [(f.path.rpartition("/")[2], ("existing", "added", "deleted")[f.status], ("data", "position deletes", "equality deletes")[f.content], f.records, f.size, f.sequence, f.file_sequence, f.snapshot) for f in self.entries()]
        return self.spark.createDataFrame(rows, "file string, status string, content string, records long, bytes long, sequence_number long, file_sequence_number long, snapshot_id long")

    def _entries(self, name: str) -> list[dict]:
        data = self._bytes(self._local(name))
        if data[:4] == avro.MAGIC:
            return list(avro.records(data))
        if data.lstrip()[:1] == b"[":
            return json.loads(data)
        raise FormatError(f"{name} is neither an Avro container nor a JSON list")

    def _manifest(self, entries: list[dict], listed: dict) -> list[DataFile]:
        """Entries of one manifest; what an added entry leaves out, it inherits from the list's row."""
        out = []
        for e in entries:
            f, status = e.get("data_file", e), e.get("status", _ADDED)
            content = f.get("content") or (1 if listed.get("content") == 1 else 0)
            gone = status == _DELETED
            if not gone and not content and str(f.get("file_format", "parquet")).lower() != "parquet":
                raise UnsupportedError(f"{f['file_path']}: data files are Parquet here")
            sequence, file_sequence, snapshot = e.get("sequence_number"), e.get("file_sequence_number"), e.get("snapshot_id")
            if status == _ADDED:
                own = listed.get("sequence_number")
                sequence, file_sequence = own if sequence is None else sequence, own if file_sequence is None else file_sequence
            snapshot = listed.get("added_snapshot_id") if snapshot is None else snapshot
            path = f["file_path"] if gone or content else self._local(f["file_path"])
            out.append(DataFile(path, f.get("record_count", 0), _bounds(f.get("lower_bounds")), _bounds(f.get("upper_bounds")), status, content, sequence, file_sequence, snapshot, f.get("file_size_in_bytes")))
        return out

    def may_match(self, file: DataFile, conjuncts: list[Conjunct]) -> bool:
        """False if the bounds rule the file out; unknown types and missing bounds never do."""
        for name, op, value in conjuncts:
            f = next((f for f in self.fields if f["name"] == name), None)
            if f is None or value is None:
                continue
            lo, hi = decode(f["type"], file.lower.get(f["id"])), decode(f["type"], file.upper.get(f["id"]))
            if isinstance(value, Decimal) and f["type"] in ("float", "double"):
                value = float(value)
            if f["type"] == "float" and isinstance(value, float):
                # Spark compares a float with a decimal or double literal as doubles; bounds are floats, so leave room
                lo, hi = _around(lo, -1), _around(hi, 1)
            try:
                if op == "=" and (lo is not None and value < lo or hi is not None and value > hi):
                    return False
                if op in ("<", "<=") and lo is not None and (lo > value or op == "<" and lo == value):
                    return False
                if op in (">", ">=") and hi is not None and (hi < value or op == ">" and hi == value):
                    return False
            except TypeError:
                continue
        return True

    def scan(self, conjuncts: list[Conjunct] = ()) -> DataFrame:
        """The current rows, without files that the conjuncts rule out; the caller still filters rows."""
        files = [f.path for f in self.files() if self.may_match(f, list(conjuncts))]
        if not files:
            return self.spark.createDataFrame([], self.schema)
        schema = self.schema
        # one footer tells whether the table's writer puts ids into its files; a file without any fails loudly then
        if b"PARQUET:field_id" in _keys(parquet_info.footer(self.spark, files[0])):
            self.spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")  # of effect only for schemas with ids
            schema = T.StructType([T.StructField(f["name"], spark_type(f["type"], True), True, {FIELD_ID: f["id"]}) for f in self.fields])
        return self.spark.read.schema(schema).parquet(*files)


def _keys(footer) -> set[bytes]:
    return {k for f in footer.schema.to_arrow_schema() for k in f.metadata or {}}


def _bounds(m) -> dict[int, bytes]:
    if isinstance(m, dict):
        return {int(k): v for k, v in m.items() if isinstance(v, bytes)}
    return {int(x["key"]): x["value"] for x in m or []}


def _around(x: float | None, side: int) -> float | None:
    return None if x is None else x + side * abs(x) * 1e-6


def decode(kind, raw: bytes | None):
    """A bound by the field's type; None if it says nothing."""
    if raw is None or not isinstance(kind, str):
        return None
    size = {"int": ("<i", 4), "date": ("<i", 4), "long": ("<q", 8), "time": ("<q", 8), "timestamp": ("<q", 8), "timestamptz": ("<q", 8), "float": ("<f", 4), "double": ("<d", 8)}.get(kind)
    if size:
        if kind in ("date", "time", "timestamp", "timestamptz") or len(raw) not in (4, 8):
            return None
        form = "<q" if kind == "long" and len(raw) == 8 else "<i" if kind == "long" else size[0] if len(raw) == size[1] else "<f"
        value = struct.unpack(form, raw)[0]
        return None if value != value else value
    if kind == "boolean":
        return raw != b"\0"
    if kind == "string":
        return None if len(raw) >= 16 else raw.decode(errors="replace")  # longer ones may be cut
    if kind.startswith("decimal"):
        return Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-int(kind.rstrip(")").split(",")[1]))
    return None


_CONJUNCT = re.compile(r"([A-Za-z_]\w*)\s*(=|<=|>=|<|>)\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|'[^'\\]*')\s*")


def conjuncts_of(where: str) -> list[Conjunct]:
    """Those of a condition's AND terms that compare a column with a literal; an OR anywhere gives none."""
    if re.search(r"\b(?:OR|NOT|CASE|BETWEEN)\b|[()]", re.sub(r"'[^']*'", "''", where), re.I):
        return []
    out = []
    for term in re.split(r"\bAND\b(?=(?:[^']*'[^']*')*[^']*$)", where, flags=re.I):
        if m := _CONJUNCT.fullmatch(term.strip()):
            v = m[3]
            out.append((m[1], m[2], v[1:-1] if v[0] == "'" else float(v) if re.search("[eE]", v) else Decimal(v) if "." in v else int(v)))
    return out


def read_iceberg(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """The current snapshot; with a condition, filtered by it and pruned first."""
    table = IcebergTable(spark, path)
    out = table.scan(conjuncts_of(where) if where else [])
    return out.filter(where) if where else out
