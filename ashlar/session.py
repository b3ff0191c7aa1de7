"""The engine's session: connect to a source, ask in SQL, look at tables."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ashlar import dialect
from ashlar.errors import EngineError
from ashlar.sources import iceberg, parquet_info, resolve


def build_session(name: str = "ashlar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; any setting can be given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf
    return builder.config(map=settings).getOrCreate()


@dataclass
class Connection:
    name: str
    path: str
    kind: str


class Engine:
    """One default connection for queries without FROM, and any number of named ones."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or build_session()
        self.connections: dict[str, Connection] = {}
        self.default: str | None = None

    def connect(self, path: str, name: str | None = None) -> Connection:
        """Registers a source under a name (its file's, unless given) and makes it the default."""
        name = name or re.sub(r"\W", "_", re.sub(r"\.\w+$", "", path.rstrip("/").rpartition("/")[2])) or "source"
        kind = resolve.kind_of(self.spark, path)
        resolve.read(self.spark, path).createOrReplaceTempView(name)
        self.connections[name] = Connection(name, path, kind)
        self.default = name
        return self.connections[name]

    def _view_of(self, name: str) -> str | None:
        known = name.rpartition(".")[2].lower() in dialect.EXTENSIONS
        if not (resolve.exists(self.spark, name) if "/" in name or known else False):
            return None
        view = "_file_" + hashlib.sha1(name.encode()).hexdigest()[:16]
        resolve.read(self.spark, name).createOrReplaceTempView(view)
        return view

    def sql(self, query: str) -> DataFrame:
        """Spark SQL, with files in FROM and JOIN, and the default table where there is no FROM."""
        default = self.default
        text = dialect.rewrite(query, self._view_of, default)
        mine = self.connections.get(default or "")
        if mine and mine.kind == "iceberg" and (where := self._where(text, mine.name)) and (found := iceberg.conjuncts_of(where)):
            # a view of the files that the condition does not rule out
            view = "_pruned_" + hashlib.sha1(text.encode()).hexdigest()[:16]
            iceberg.IcebergTable(self.spark, mine.path).scan(found).createOrReplaceTempView(view)
            text = re.sub(rf"\bFROM\s+{re.escape(mine.name)}\b", f"FROM {view} AS {mine.name}", text, count=1, flags=re.I)
        return self.spark.sql(text)

    @staticmethod
    def _where(text: str, name: str) -> str | None:
        """The condition of a query over one table and nothing else."""
        plain = re.sub(r"'(?:[^'\\]|\\.)*'", lambda m: "'" + "x" * (len(m[0]) - 2) + "'", text)
        if re.search(r"\b(?:JOIN|UNION|INTERSECT|EXCEPT|WITH)\b|--|/\*|\(\s*SELECT", plain, re.I):
            return None
        m = re.search(rf"\bFROM\s+{re.escape(name)}\s+WHERE\s+(.*?)(?=\s+(?:GROUP|HAVING|ORDER|LIMIT|OFFSET)\b|\s*$)", plain, re.I | re.S)
        return text[m.start(1) : m.end(1)] if m else None

    def table(self, name: str | None = None) -> DataFrame:
        if name is None and self.default is None:
            raise EngineError("not connected to a source")
        return self.spark.table(name or self.default)

    def schema(self, name: str | None = None) -> str:
        return "\n".join(f"{f.name}: {f.dataType.simpleString()}{'' if f.nullable else ' not null'}" for f in self.table(name).schema)

    def info(self, name: str | None = None) -> dict:
        """What a connection is: kind, path, columns and rows; for Iceberg also format version, files and records, for a
        Parquet file its row groups (from the footer), for a folder its files."""
        c = self.connections[name or self.default or ""]
        out = {"name": c.name, "path": c.path, "kind": c.kind, "columns": len(self.table(c.name).columns)}
        if c.kind == "iceberg":
            t = iceberg.IcebergTable(self.spark, c.path)
            files = t.files()
            return out | {"format_version": t.metadata.get("format-version"), "snapshot": t.metadata.get("current-snapshot-id"), "files": len(files), "rows": sum(f.records for f in files)}
        if c.kind == "parquet":
            found = parquet_info.files(self.spark, c.path)
            if found == [c.path]:
                m = parquet_info.footer(self.spark, c.path)
                return out | {"row_groups": m.num_row_groups, "rows": m.num_rows}
            out["files"] = len(found)
        return out | {"rows": self.table(c.name).count()}

    def preview(self, name: str | None = None, rows: int = 10) -> DataFrame:
        """The first rows of a connection."""
        return self.table(name).limit(rows)

    def tables(self) -> list[str]:
        return sorted(self.connections)

    def refresh(self, name: str | None = None) -> None:
        """Looks at the source's files again."""
        c = self.connections[name or self.default or ""]
        if c.kind != "iceberg":
            self.spark.catalog.refreshByPath(c.path)
        was, _ = self.default, self.connect(c.path, c.name)
        self.default = was

    def show(self, query: str, rows: int | None = 10, width: int = 50) -> str:
        """A table of the first rows (all if None), each value cut at a width, and the number of rows shown."""
        return self.display(self.sql(query), rows, width)

    def inside(self, name: str | None = None) -> DataFrame:
        """An Iceberg table's manifest entries, or a Parquet source's column chunks."""
        c = self.connections[name or self.default or ""]
        if c.kind == "iceberg":
            return iceberg.IcebergTable(self.spark, c.path).summary()
        if c.kind == "parquet":
            return parquet_info.chunks(self.spark, c.path)
        raise EngineError(f"{c.name} is {c.kind}: there is nothing to look into")

    @staticmethod
    def display(df: DataFrame, rows: int | None = 10, width: int = 50) -> str:
        got = df.collect() if rows is None else df.take(rows + 1)
        more = rows is not None and len(got) > rows
        cells = [["NULL" if v is None else str(v) if len(str(v)) <= width else str(v)[: width - 3] + "..." for v in r] for r in (got[:rows] if more else got)]
        size = [max([len(n), *(len(r[i]) for r in cells)]) for i, n in enumerate(df.columns)]
        line = "+" + "+".join("-" * (s + 2) for s in size) + "+"
        row = lambda r: "|" + "|".join(f" {v.center(s)} " for v, s in zip(r, size, strict=True)) + "|"
        n = len(cells)
        return "\n".join([line, row(df.columns), line, *map(row, cells), line, f"{n} row{'s' * (n != 1)}" + " (there are more; 'full <query>' shows all)" * more])
