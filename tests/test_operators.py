"""The semantics decisions: nulls, names, empty inputs, and small golden cases."""

import pytest
from pyspark.sql import functions as F

from ashlar.operators.relational import aggregate, aggregate_column, order, rank, set_operation


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, 20), (2, 30), (3, 25), (4, 40), (5, 26)], "id long, age long")


def test_filters(people):
    assert [r.id for r in people.filter("age > 25").orderBy("id").collect()] == [2, 4, 5]
    assert [r.id for r in people.filter((F.col("age") >= 25) & (F.col("id") <= 3)).orderBy("id").collect()] == [2, 3]


def test_three_valued_logic(spark):
    df = spark.createDataFrame([(1, 100), (2, None)], "id long, v int")
    assert df.filter(~(F.col("v") == 100)).count() == 0
    assert df.filter("v = NULL").count() == 0
    assert df.filter(F.col("v").isNull()).count() == 1


def test_nulls_are_a_group_and_not_counted(spark):
    df = spark.createDataFrame([("a", 1), (None, None), (None, 2), ("NULL", 5)], "k string, v int")
    got = {r.k: (r["COUNT(*)"], r["COUNT(v)"], r["SUM(v)"]) for r in aggregate(df, [("count", "*"), ("count", "v"), ("sum", "v")], ["k"]).collect()}
    assert got == {"a": (1, 1, 1), None: (2, 1, 2), "NULL": (1, 1, 5)}


def test_empty_aggregates_are_null(people):
    assert tuple(aggregate(people.filter("id < 0"), [("count", "*"), ("sum", "age"), ("min", "age")]).first()) == (0, None, None)


def test_aggregate_errors():
    with pytest.raises(ValueError):
        aggregate_column("sum", "*")
    with pytest.raises(ValueError):
        aggregate_column("median", "x")


def test_order_is_global_with_nulls_last(spark):
    df = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(20)], "a int, b int").repartition(5)
    rows = [tuple(r) for r in order(df, "a", "-b", limit=18, offset=1).collect()]
    want = sorted(((i % 3 if i % 5 else None, i) for i in range(20)), key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert rows == want[1:19]


def test_rank_and_sets(spark, people):
    got = rank(people.withColumn("k", F.lit(1)), ["k"], [F.col("age")], r="rank", d="dense_rank", n="row_number").orderBy("age")
    assert [(x.r, x.d, x.n) for x in got.collect()] == [(i, i, i) for i in range(1, 6)]
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert {k: sorted(r.x for r in set_operation(k, a, b).collect()) for k in ("union", "union_all", "intersect", "except")} == {"union": [1, 2, 3], "union_all": [1, 1, 2, 2, 3], "intersect": [2], "except": [1]}
