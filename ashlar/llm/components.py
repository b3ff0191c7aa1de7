"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.sources import fs

from .common import shared_folder


#: Spark's setting to delete an execution's shuffle files at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here, and a lost executor loses nothing.

    The shuffle files behind it go at once rather than when the driver next collects its garbage.
    """
    spark: SparkSession = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        fs.delete(t.sparkSession, t.stored_at)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each linked node; component is the smallest node reachable.

    ``links`` has long columns a and b.  Each step needs the minimum of a node's neighbours only, which is combined
    before the shuffle; the minima are stored, so that the join of a hub's rows with its minimum is one of two plain
    shuffles, which adaptive execution splits where a hub is hot.  The steps halve the depth of every tree.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # u's smaller neighbours: few, whatever the hub
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).where("u > v").distinct()
        after_edges = stored(small, "links")
        forget(edges, low, large)
        edges, after = after_edges, _digest(after_edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
