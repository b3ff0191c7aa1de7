"""Avro and Iceberg against files that the tests write, and the session over them."""

import io
import json
import struct
import zlib

import pyarrow.parquet as pq
import pytest

from ashlar.__main__ import execute
from ashlar.errors import FormatError, SourceError, UnsupportedError
from ashlar.plans.source_catalog import QUERIES
from ashlar.session import Engine
from ashlar.sources import avro, iceberg, resolve


def long(n):
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode(schema, v):
    if isinstance(schema, list):
        i = next(i for i, s in enumerate(schema) if (s == "null") == (v is None))
        return long(i) + encode(schema[i], v)
    kind = schema if isinstance(schema, str) else schema["type"]
    if kind == "kv":
        schema, kind = BOUND["items"], "record"
    if kind == "null":
        return b""
    if kind in ("int", "long"):
        return long(v)
    if kind == "double":
        return struct.pack("<d", v)
    if kind == "boolean":
        return bytes([v])
    if kind in ("string", "bytes"):
        raw = v.encode() if isinstance(v, str) else v
        return long(len(raw)) + raw
    if kind == "array":
        return (long(-len(v)) + long(sum(len(encode(schema["items"], x)) for x in v)) + b"".join(encode(schema["items"], x) for x in v) if v else b"") + b"\0"
    if kind == "record":
        return b"".join(encode(f["type"], v[f["name"]]) for f in schema["fields"])
    raise AssertionError(kind)


def container(schema, rows, codec="null", sync=b"s" * 16, per=2):
    out = io.BytesIO()
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    out.write(b"Obj\x01" + long(len(meta)) + b"".join(encode("string", k) + encode("bytes", v) for k, v in meta.items()) + b"\0" + sync)
    for i in range(0, len(rows), per):
        block = b"".join(encode(schema, r) for r in rows[i : i + per])
        if codec == "deflate":
            c = zlib.compressobj(wbits=-15)
            block = c.compress(block) + c.flush()
        out.write(long(len(rows[i : i + per])) + long(len(block)) + block + sync)
    return out.getvalue()


PEOPLE = {"type": "record", "name": "p", "fields": [{"name": "name", "type": ["null", "string"]}, {"name": "dept", "type": "string"}, {"name": "age", "type": "int"}, {"name": "tags", "type": {"type": "array", "items": "long"}}, {"name": "pay", "type": ["null", "double"]}]}
ROWS = [{"name": "a", "dept": "x", "age": 30, "tags": [1, 2], "pay": 1.5}, {"name": None, "dept": "y", "age": -4, "tags": [], "pay": None}, {"name": "c", "dept": "x", "age": 41, "tags": [7], "pay": 2.5}]


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro(spark, tmp_path, codec):
    (tmp_path / "people.avro").write_bytes(container(PEOPLE, ROWS, codec))
    df = avro.read_avro(spark, str(tmp_path / "people.avro"))
    assert [r.asDict() for r in df.collect()] == ROWS
    e = Engine(spark)
    assert e.connect(str(tmp_path / "people.avro")).kind == "avro"
    assert [tuple(r) for r in e.sql("SELECT dept, COUNT(*) AS n, MAX(age) AS m WHERE age > 0 GROUP BY dept").collect()] == [("x", 2, 41)]


def test_avro_is_split_at_its_markers(spark, tmp_path, monkeypatch):
    rows = [{**ROWS[i % 3], "age": i, "dept": "x\n" * (i % 40)} for i in range(4000)]
    for codec, sync in (("deflate", bytes(range(128, 144))), ("null", b"\n\r\0\xff" * 4)):
        (tmp_path / f"{codec}.avro").write_bytes(container(PEOPLE, rows, codec, sync, per=7))
    monkeypatch.setattr(avro, "SPLIT", 1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = avro.read_avro(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 8
        got = sorted([r.asDict() for r in df.collect()], key=lambda r: r["age"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [r for r in rows for _ in range(2)]


def test_avro_errors():
    good = container(PEOPLE, ROWS)
    with pytest.raises(FormatError):
        list(avro.records(b"PAR1" + good))
    with pytest.raises(FormatError):
        list(avro.records(good[:-1] + b"?"))
    with pytest.raises(UnsupportedError):
        list(avro.records(container(PEOPLE, ROWS, "lzma")))


BOUND = {"type": "array", "items": {"type": "record", "name": "kv", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}]}}
DATA_FILE = {"type": "record", "name": "f", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"}, {"name": "lower_bounds", "type": ["null", BOUND]}, {"name": "upper_bounds", "type": ["null", "kvs"]}]}
ENTRY = {"type": "record", "name": "e", "fields": [{"name": "status", "type": "int"}, {"name": "data_file", "type": json.loads(json.dumps(DATA_FILE).replace('"kvs"', json.dumps({"type": "array", "items": "kv"})))}]}
LIST = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "content", "type": "int"}]}


def bounds(age, price):
    return [{"key": 2, "value": struct.pack("<q", age)}, {"key": 3, "value": struct.pack("<d", price)}]


def make_table(spark, root, kind="full", content=0, snapshot=7):
    (root / "metadata").mkdir(parents=True)
    files = []
    for i in range(3):
        p = root / "data" / f"part-{i}.parquet"
        spark.createDataFrame([(10 * i + j, 10 * i + j, float(i)) for j in range(4)], "id long, age long, price double").coalesce(1).write.parquet(str(root / f"tmp{i}"))
        p.parent.mkdir(exist_ok=True)
        next((root / f"tmp{i}").glob("part-*.parquet")).rename(p)
        files.append(f"/old/place/t/data/{p.name}")
    entries = [{"status": s, "data_file": {"content": content, "file_path": f, "file_format": "PARQUET", "record_count": 4, "lower_bounds": bounds(10 * i, float(i)), "upper_bounds": bounds(10 * i + 3, float(i))}} for i, (s, f) in enumerate(zip([0, 1, 1], files, strict=True))]
    entries.append({"status": 2, "data_file": {**entries[0]["data_file"], "file_path": "/old/place/t/data/gone.parquet"}})
    if kind == "json":
        (root / "metadata/list.avro").write_text(json.dumps([{"manifest_path": f"t\\data/part-{i}.parquet", "added_rows_count": 4} for i in range(3)]))
    else:
        (root / "metadata/m0.avro").write_bytes(container(ENTRY, entries))
        (root / "metadata/list.avro").write_bytes(container(LIST, [{"manifest_path": "file:/old/place/t/metadata/m0.avro", "content": 0}]))
    meta = {"format-version": 2, "location": "file:///old/place/t", "current-schema-id": 0, "schemas": [{"schema-id": 0, "fields": [{"id": 1, "name": "id", "required": True, "type": "long"}, {"id": 2, "name": "age", "required": False, "type": "long"}, {"id": 3, "name": "price", "required": False, "type": "double"}]}], "current-snapshot-id": snapshot, "snapshots": [{"snapshot-id": 7, "manifest-list": "/old/place/t/metadata/list.avro"}]}
    (root / "metadata/v2.metadata.json").write_text(json.dumps(meta))
    (root / "metadata/v1.metadata.json").write_text("{}")
    return str(root)


@pytest.mark.parametrize("kind", ["full", "json"])
def test_iceberg(spark, tmp_path, kind):
    path = make_table(spark, tmp_path / "t", kind)
    assert resolve.kind_of(spark, path) == "iceberg"
    assert iceberg.read_iceberg(spark, path).count() == 12
    assert sorted(r.id for r in iceberg.read_iceberg(spark, path, "age >= 12 AND price < 2").collect()) == [12, 13]


def test_iceberg_pruning(spark, tmp_path):
    t = iceberg.IcebergTable(spark, make_table(spark, tmp_path / "t"))
    left = lambda w: [f.path[-9] for f in t.files() if t.may_match(f, iceberg.conjuncts_of(w))]
    assert left("age > 13") == ["2"] and left("age = 11") == ["1"] and left("price <= 0") == ["0"] and left("price < 0") == []
    assert left("age > 100 OR id = 1") == ["0", "1", "2"] and left("age > 5 AND price < 2.0") == ["1"]
    e = Engine(spark)
    e.connect(t.path)
    df = e.sql("SELECT COUNT(*) AS n FROM t WHERE age > 13")
    assert len(df.inputFiles()) == 1 and df.first().n == 4
    assert e.info()["files"] == 3


def test_iceberg_edges(spark, tmp_path):
    assert iceberg.read_iceberg(spark, make_table(spark, tmp_path / "none", snapshot=-1)).columns == ["id", "age", "price"]
    with pytest.raises(UnsupportedError):
        iceberg.read_iceberg(spark, make_table(spark, tmp_path / "del", content=1))
    (tmp_path / "del/metadata/m0.avro").unlink()
    with pytest.raises(SourceError):
        iceberg.read_iceberg(spark, str(tmp_path / "del"))


def test_iceberg_decimal_bounds(spark, tmp_path):
    t = iceberg.IcebergTable(spark, make_table(spark, tmp_path / "t"))
    t.fields[2]["type"] = "decimal(9,2)"
    f = iceberg.DataFile("p", 1, {3: b"\x6e"}, {3: b"\x6e"})  # 1.10
    left = lambda w: t.may_match(f, iceberg.conjuncts_of(w))
    assert left("price = 1.1") and left("price >= 1.1") and left("price <= 1.10") and not left("price > 1.1") and not left("price = 1.11") and not left("price < 1.1")
    t.fields[2]["type"] = "double"
    f = iceberg.DataFile("p", 1, {3: struct.pack("<d", 1.1)}, {3: struct.pack("<d", 1.1)})
    assert left("price = 1.1") and left("price >= 1.1") and not left("price > 1.1")
    t.fields[2]["type"] = "float"
    f = iceberg.DataFile("p", 1, {3: struct.pack("<f", 1.1)}, {3: struct.pack("<f", 1.1)})
    assert left("price > 1.1") and left("price >= 1.1") and not left("price < 1.0")


def test_remote_table_is_recognised(spark, tmp_path):
    make_table(spark, tmp_path / "t")
    path = f"file://{tmp_path}/t"
    assert resolve.kind_of(spark, path) == "iceberg" and iceberg.read_iceberg(spark, path, "age >= 12").count() == 6
    with pytest.raises(SourceError, match="HTTP"):
        resolve.kind_of(spark, "https://example.org/t")


def test_bounds_by_type():
    assert iceberg.decode("double", struct.pack("<d", 1.5)) == 1.5 and iceberg.decode("int", struct.pack("<i", -3)) == -3
    assert iceberg.decode("long", struct.pack("<q", 9)) == 9 and iceberg.decode("double", struct.pack("<d", float("nan"))) is None
    assert iceberg.decode("string", b"abc") == "abc" and iceberg.decode({"type": "list"}, b"x") is None and iceberg.decode("decimal(9,2)", b"\xff\x38") == -2


def test_session_and_shell(spark, sf_dir):
    e = Engine(spark)
    assert execute(e, "SELECT a").startswith("error") and "connected to parquet nation" in execute(e, f"\\c {sf_dir}/nation.parquet")
    assert execute(e, "SELECT n_name ORDER BY n_nationkey LIMIT 2").splitlines()[-1] == "2 rows"
    assert "there are more" in execute(e, "SELECT *") and execute(e, "full SELECT *").endswith("25 rows")
    assert "n_name: string" in execute(e, "\\d") and "rows: 25" in execute(e, "\\info") and execute(e, "\\tables") == "nation" and execute(e, "\\refresh") == "refreshed"
    assert execute(e, "exit") is None and execute(e, "SELEC").startswith("error")
    with pytest.raises(SourceError):
        e.connect("/no/such/place")


@pytest.mark.parametrize("layout", ["row groups", "folder", "no rows"])
def test_summary_whatever_the_layout(spark, sf_dir, tmp_path, layout):
    """info() counts the row groups that a file has; the registered query is over a file of one, for any layout of orders."""
    orders, path = pq.read_table(f"{sf_dir}/orders.parquet"), tmp_path / "orders.parquet"
    if layout == "folder":
        path.mkdir()
        pq.write_table(orders[:700], path / "part-0.parquet")
        pq.write_table(orders[700:], path / "part-1.parquet", row_group_size=300)
    else:
        orders = orders[:0] if layout == "no rows" else orders
        pq.write_table(orders, path, row_group_size=400)
    if layout == "row groups":
        e = Engine(spark)
        e.connect(str(path))
        assert e.info()["row_groups"] == 4
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "2048")  # Spark's writer would cut these rows too
    try:
        assert [tuple(r) for r in QUERIES["parquet_info_summary"](spark, str(tmp_path)).collect()] == [("parquet", "orders", 6, orders.num_rows, 1)]
    finally:
        conf.unset("parquet.block.size")
