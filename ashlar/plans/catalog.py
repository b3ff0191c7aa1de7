"""The engine's registered queries: a DataFrame formulation and, for the oracle, an SQL one of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ashlar.operators.relational import aggregate, order, rank, set_operation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """``t.nation`` is the table nation of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def _add(name: str, sql: str, build: Callable[[Tables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    ORACLE[name] = sql


c = F.col
_labelled = lambda t: t.documents.select("doc_id").join(t.labels, "doc_id", "left")

# scan, projection, filter
_add("scan_star", "SELECT * FROM nation", lambda t: t.nation)
_add("project_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer", lambda t: t.customer.select("c_custkey", "c_name", "c_acctbal"))
_add("filter_int_gt", "SELECT p_partkey, p_size FROM part WHERE p_size > 30", lambda t: t.part.filter(c("p_size") > 30).select("p_partkey", "p_size"))
_add("filter_float_le", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 1234.5", lambda t: t.customer.filter(c("c_acctbal") <= 1234.5).select("c_custkey", "c_acctbal"))
_add("filter_string_eq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", lambda t: t.orders.filter(c("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus"))
_add("filter_ne", "SELECT p_partkey FROM part WHERE p_size <> 10", lambda t: t.part.filter(c("p_size") != 10).select("p_partkey"))
_add("filter_and_or_paren", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 OR l_quantity >= 45) AND l_returnflag = 'R'", lambda t: t.lineitem.filter(((c("l_quantity") < 5) | (c("l_quantity") >= 45)) & (c("l_returnflag") == "R")).select("l_orderkey", "l_linenumber"))
_add("filter_not", "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F'", lambda t: t.orders.filter(~(c("o_orderstatus") == "F")).select("o_orderkey"))
_add("filter_col_vs_col", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax", lambda t: t.lineitem.filter(c("l_discount") > c("l_tax")).select("l_orderkey", "l_linenumber"))
_add("filter_3vl_not", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 1)", lambda t: _labelled(t).filter(~(c("quality") == 1)).select("doc_id"))
_add("filter_bool_literal", "SELECT r_regionkey FROM region WHERE TRUE AND r_regionkey < 3", lambda t: t.region.filter(F.lit(True) & (c("r_regionkey") < 3)).select("r_regionkey"))
_add("filter_unary_minus", "SELECT s_suppkey, -s_acctbal AS owed FROM supplier WHERE -s_acctbal > -100", lambda t: t.supplier.filter(-c("s_acctbal") > -100).select("s_suppkey", (-c("s_acctbal")).alias("owed")))
_add("arith_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber % 2 AS parity FROM lineitem", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"), (c("l_linenumber") % 2).alias("parity")))
_add("filter_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5)", lambda t: t.customer.filter(c("c_nationkey").isin(1, 3, 5)).select("c_custkey"))
_add("filter_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", lambda t: t.part.filter(c("p_size").between(10, 20)).select("p_partkey"))
_add("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%'", lambda t: t.part.filter(c("p_type").like("PROMO%")).select("p_partkey", "p_type"))
_add("filter_is_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL", lambda t: _labelled(t).filter(c("quality").isNull()).select("doc_id"))
_add("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END AS bucket FROM part", lambda t: t.part.select("p_partkey", F.when(c("p_size") < 10, "S").when(c("p_size") < 30, "M").otherwise("L").alias("bucket")))
_add("scalar_functions", "SELECT n_nationkey, upper(substr(n_name, 1, 3)) AS tag, CAST(length(n_name) AS INTEGER) AS n FROM nation", lambda t: t.nation.select("n_nationkey", F.upper(F.substring("n_name", 1, 3)).alias("tag"), F.length("n_name").alias("n")))

# aggregation
_add("agg_count_star", "SELECT COUNT(*) AS cnt FROM lineitem", lambda t: aggregate(t.lineitem, [F.count("*").alias("cnt")]))
_add("agg_all", "SELECT COUNT(*) AS cnt, ROUND(SUM(l_quantity), 2) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_quantity) AS mn, MAX(l_quantity) AS mx FROM lineitem", lambda t: aggregate(t.lineitem, [F.count("*").alias("cnt"), F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_quantity"), 6).alias("a"), F.min("l_quantity").alias("mn"), F.max("l_quantity").alias("mx")]))
_add("agg_filtered", "SELECT COUNT(*) AS cnt, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem WHERE l_quantity > 25", lambda t: aggregate(t.lineitem.filter(c("l_quantity") > 25), [F.count("*").alias("cnt"), F.round(F.sum("l_extendedprice"), 2).alias("s")]))
_add("agg_empty_input", "SELECT COUNT(*) AS cnt, SUM(p_retailprice) AS s, MIN(p_size) AS mn FROM part WHERE p_size < 0", lambda t: aggregate(t.part.filter(c("p_size") < 0), [F.count("*").alias("cnt"), F.sum("p_retailprice").alias("s"), F.min("p_size").alias("mn")]))
_add("agg_count_nullable", "SELECT COUNT(*) AS n, COUNT(l.quality) AS nq FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", lambda t: aggregate(_labelled(t), [F.count("*").alias("n"), F.count("quality").alias("nq")]))
_add("agg_min_max_string", "SELECT MIN(n_name) AS mn, MAX(n_name) AS mx FROM nation", lambda t: aggregate(t.nation, [F.min("n_name").alias("mn"), F.max("n_name").alias("mx")]))
_add("group_by_single", "SELECT c_mktsegment, COUNT(*) AS cnt FROM customer GROUP BY c_mktsegment", lambda t: aggregate(t.customer, [F.count("*").alias("cnt")], ["c_mktsegment"]))
_add("group_by_multi", "SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag, l_linestatus", lambda t: aggregate(t.lineitem.filter(c("l_quantity") > 25), [F.count("*").alias("cnt"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price")], ["l_returnflag", "l_linestatus"]))
_add("group_by_filtered", "SELECT event_type, COUNT(*) AS cnt, MAX(value) AS mx FROM events WHERE value > 10 GROUP BY event_type", lambda t: aggregate(t.events.filter(c("value") > 10), [F.count("*").alias("cnt"), F.max("value").alias("mx")], ["event_type"]))
_add("group_by_no_agg", "SELECT p_brand FROM part GROUP BY p_brand", lambda t: aggregate(t.part, [], ["p_brand"]))
_add("group_by_having", "SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", lambda t: aggregate(t.orders, [F.count("*").alias("cnt")], ["o_custkey"], having=c("cnt") > 12))
_add("group_by_null_key", "SELECT l.quality AS quality, COUNT(*) AS cnt FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality", lambda t: aggregate(_labelled(t), [F.count("*").alias("cnt")], ["quality"]))
_add("group_default_names", 'SELECT o_orderstatus, COUNT(*) AS "COUNT(*)", MAX(o_orderkey) AS "MAX(o_orderkey)" FROM orders GROUP BY o_orderstatus', lambda t: aggregate(t.orders, [("count", "*"), ("max", "o_orderkey")], ["o_orderstatus"]))

# order and limit
_add("group_order_limit", "SELECT p_brand, COUNT(*) AS cnt FROM part GROUP BY p_brand ORDER BY cnt DESC, p_brand ASC LIMIT 5", lambda t: order(aggregate(t.part, [F.count("*").alias("cnt")], ["p_brand"]), "-cnt", "p_brand", limit=5))
_add("order_by_desc_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10", lambda t: order(t.orders.select("o_orderkey", "o_totalprice"), "-o_totalprice", "o_orderkey", limit=10))
_add("order_by_multi_key", "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY s_nationkey ASC, s_suppkey DESC", lambda t: order(t.supplier.select("s_nationkey", "s_suppkey"), "s_nationkey", "-s_suppkey"))
_add("order_by_nulls_limit", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS LAST, d.doc_id LIMIT 50", lambda t: order(_labelled(t).select("doc_id", "quality"), "quality", "doc_id", limit=50))
_add("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20", lambda t: order(t.customer.select("c_custkey", "c_name"), "c_custkey", limit=10, offset=20))
_add("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", lambda t: t.orders.select("o_orderstatus", "o_orderpriority").distinct())
_add("count_distinct", "SELECT COUNT(DISTINCT o_custkey) AS n FROM orders", lambda t: t.orders.agg(F.count_distinct("o_custkey").alias("n")))

# joins
_add("join_inner", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", lambda t: t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name"))
_add("join_left", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", lambda t: _labelled(t).select("doc_id", "quality"))
_add("join_right", "SELECT l.doc_id AS ldoc, d.doc_id AS ddoc FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id", lambda t: t.labels.select(c("doc_id").alias("ldoc")).join(t.documents.select(c("doc_id").alias("ddoc")), c("ldoc") == c("ddoc"), "right"))
_add("join_full", "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey", lambda t: t.customer.join(t.supplier, c("c_custkey") == c("s_suppkey"), "full").select("c_custkey", "s_suppkey"))
_add("join_cross", "SELECT n.n_nationkey, r.r_regionkey FROM nation n CROSS JOIN region r", lambda t: t.nation.select("n_nationkey").crossJoin(t.region.select("r_regionkey")))
_add("join_using", "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)", lambda t: t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "toxic"))
_add("join_group", "SELECT n.n_name, ROUND(SUM(o.o_totalprice), 2) AS rev FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", lambda t: aggregate(t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")), [F.round(F.sum("o_totalprice"), 2).alias("rev")], ["n_name"]))

# sets, subqueries
_keys = lambda t: (t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k")))
_add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", lambda t: set_operation("union", *_keys(t)))
_add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier", lambda t: set_operation("union_all", *_keys(t)))
_add("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier", lambda t: set_operation("intersect", *_keys(t)))
_add("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000", lambda t: set_operation("except", t.nation.select(c("n_nationkey").alias("k")), t.supplier.filter(c("s_acctbal") > 5000).select("s_nationkey")))
_add("cte", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT COUNT(*) AS n FROM big WHERE t > 1000000", lambda t: t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).filter(c("t") > 1000000).agg(F.count("*").alias("n")))
_add("subquery_derived", "SELECT MAX(cnt) AS mx FROM (SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey) t", lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("cnt")).agg(F.max("cnt").alias("mx")))
_add("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", lambda t: t.customer.join(t.orders.filter(c("o_totalprice") > 400000), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey"))
_add("subquery_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda t: t.customer.join(t.orders, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey"))
_add("subquery_scalar", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)", lambda t: t.part.crossJoin(F.broadcast(t.part.agg(F.avg("p_retailprice").alias("_mean")))).filter(c("p_retailprice") > c("_mean")).select("p_partkey"))

# windows
_add("window_row_number", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders", lambda t: rank(t.orders, ["o_custkey"], [c("o_totalprice").desc(), c("o_orderkey")], rn="row_number").select("o_orderkey", "rn"))
_add("window_rank", "SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS rk, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS drk FROM part", lambda t: rank(t.part, ["p_brand"], [c("p_size")], rk="rank", drk="dense_rank").select("p_partkey", "rk", "drk"))
_add("window_agg", "SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_nationkey) AS cnt, MAX(c_acctbal) OVER (PARTITION BY c_nationkey) AS mx FROM customer", lambda t: t.customer.select("c_custkey", F.count("*").over(Window.partitionBy("c_nationkey")).alias("cnt"), F.max("c_acctbal").over(Window.partitionBy("c_nationkey")).alias("mx")))


def _through_engine(name: str, oracle: str, sql: str) -> None:
    """Queries that go through the session's own dialect: paths and the default table."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ashlar.session import Engine

        engine = Engine(spark)
        engine.connect(f"{sf_dir}/orders.parquet")
        return engine.sql(sql.replace("{dir}", sf_dir))

    QUERIES[name], ORACLE[name] = build, oracle


_through_engine("sql_default_table", "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) AS n WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
_through_engine("sql_from_path", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'from x'", "SELECT n.n_name, r.r_name FROM '{dir}/nation.parquet' n JOIN \"{dir}/region.parquet\" r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'from x' -- FROM nothing")
_through_engine("sql_constant", "SELECT 1 AS one, 'a' AS letter", "SELECT 1 AS one, 'a' AS letter")
