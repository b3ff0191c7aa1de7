"""Relational operators over DataFrames, with the engine's semantics: three-valued logic, explicit null order, names kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Aggregate = tuple[str, str]  # ("sum", "price"); ("count", "*")

_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}


def aggregate_column(kind: str, column: str) -> Column:
    """An aggregate named as written: COUNT(*), SUM(price)."""
    if kind not in _AGGREGATES:
        raise ValueError(f"no aggregate {kind!r}; there are {', '.join(_AGGREGATES)}")
    if column == "*" and kind != "count":
        raise ValueError(f"{kind.upper()}(*) has no meaning")
    name = f"COUNT(DISTINCT {column})" if kind == "count_distinct" else f"{kind.upper()}({column})"
    return (F.count("*") if column == "*" else _AGGREGATES[kind](column)).alias(name)


def aggregate(df: DataFrame, aggregates: Sequence[Aggregate | Column], by: Sequence[str] = (), having: Column | str | None = None) -> DataFrame:
    """Grouped or global aggregation: partial sums before the shuffle, NULL a group of its own; without aggregates, the distinct keys."""
    if not aggregates:
        return df.select(*by).distinct()
    cols = [a if isinstance(a, Column) else aggregate_column(*a) for a in aggregates]
    out = df.groupBy(*by).agg(*cols) if by else df.agg(*cols)
    return out.filter(having) if having is not None else out


def order(df: DataFrame, *keys: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Global order by all keys ("-x" descends), nulls last; with a limit it is a top-k and not a full sort."""
    out = df.orderBy(*[F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys])
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def rank(df: DataFrame, by: Sequence[str], keys: Sequence[Column], **named: str) -> DataFrame:
    """Adds row_number, rank or dense_rank columns: ``rank(df, ["k"], [F.col("v")], rn="row_number")``."""
    w = Window.partitionBy(*by).orderBy(*keys)
    return df.withColumns({name: getattr(F, kind)().over(w) for name, kind in named.items()})


def set_operation(kind: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """union, union_all, intersect or except, with SQL's distinctness."""
    return {"union": lambda: a.union(b).distinct(), "union_all": lambda: a.union(b), "intersect": lambda: a.intersect(b), "except": lambda: a.subtract(b)}[kind]()
