"""Named queries over the driver's tables, each with SQL that DuckDB runs for the same rows.

Most texts are one for both engines.  ``{name}`` stands for a table: Spark gets the
DataFrame itself (``spark.sql(text, name=df)``), so no view is left in the session and
the scan keeps its pruning and pushed filters.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import compat

TABLE = re.compile(r"\{(\w+)\}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{name: read(spark, sf_dir, name) for name in set(TABLE.findall(text))})


def for_duckdb(text: str) -> str:
    return TABLE.sub(r"\1", text)


REVENUE = "l.l_extendedprice * (1 - l.l_discount)"

SHARED = {
    # Scans and projections
    "scan_region": "SELECT r_regionkey, r_name FROM {region}",
    "project_alias": "SELECT n_nationkey AS id, n_name AS nation_name FROM {nation}",
    "project_arith": "SELECT l_orderkey, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net, round(-l_quantity + 2 / 4, 2) AS shifted FROM {lineitem}",
    "project_literal": "SELECT r_name, 'fixed' AS label, 7 AS seven, CAST(1.5 AS DOUBLE) AS num FROM {region}",
    "select_without_from": "SELECT 1 AS one, 'x' AS letter",
    "select_distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}",
    # Filters
    "filter_cmp": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice >= 200000 AND o_orderkey != 7 AND o_custkey < 1000",
    "filter_and_or": "SELECT p_partkey, p_size, p_type FROM {part} WHERE (p_size < 10 AND p_type = 'PROMO') OR (p_size > 40 AND p_type = 'SMALL')",
    "filter_is_null": "SELECT o.o_orderkey, o.o_custkey FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NULL",
    "filter_is_not_null": "SELECT DISTINCT o.o_orderkey FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey IS NOT NULL",
    "filter_in_list": "SELECT n_name FROM {nation} WHERE n_regionkey IN (1, 3)",
    "filter_not_in_list": "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    "filter_like": "SELECT c_custkey, c_name FROM {customer} WHERE c_name LIKE '%1_'",
    "filter_not_like": "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderpriority NOT LIKE '%LOW%'",
    "filter_date_range": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM {orders} WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-04-01 00:00:00'",
    "filter_date_like": "SELECT o_orderkey FROM {orders} WHERE CAST(o_orderdate AS STRING) LIKE '1997-03%'",
    "filter_between": "SELECT p_partkey, p_retailprice FROM {part} WHERE p_size BETWEEN 5 AND 9",
    "filter_not": "SELECT s_suppkey, s_acctbal FROM {supplier} WHERE NOT (s_acctbal > 0 OR s_nationkey = 3)",
    "filter_bool": "SELECT o_orderkey, (o_totalprice > 100000) AS large FROM {orders} WHERE (o_orderstatus = 'F') = TRUE",
    "filter_scalar_operand": "SELECT c_custkey, c_acctbal FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer})",
    # Joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT o.o_orderkey, count(l.l_orderkey) AS items FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey",
    "join_right": "SELECT o.o_orderkey, l.l_partkey FROM {lineitem} l RIGHT OUTER JOIN {orders} o ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 45",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM (SELECT * FROM {supplier} WHERE s_suppkey % 2 = 0) s FULL OUTER JOIN (SELECT * FROM {customer} WHERE c_custkey % 3 = 0) c ON s.s_suppkey = c.c_custkey",
    "join_full_whole": "SELECT o.o_orderkey, l.l_orderkey, l.l_linenumber, l.l_partkey FROM {orders} o FULL OUTER JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey",
    "join_cross": "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n",
    "join_comma": "SELECT n.n_name, r.r_name FROM {nation} n, {region} r WHERE n.n_regionkey = r.r_regionkey",
    "join_natural": "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM {nation}) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM {region}) b",
    "join_theta": "SELECT a.n_name AS low, b.n_name AS high FROM {nation} a JOIN {nation} b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey",
    "join_self": "SELECT a.n_name AS one, b.n_name AS other FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_using": "SELECT custkey, o_orderkey, c_name FROM (SELECT o_custkey AS custkey, o_orderkey FROM {orders}) o JOIN (SELECT c_custkey AS custkey, c_name FROM {customer}) c USING (custkey)",
    "join_multiway": "SELECT l.l_orderkey, l.l_partkey, c.c_name, n.n_name, r.r_name FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' AND l.l_quantity > 30",
    "join_derived": "SELECT c.c_name, t.n_orders FROM {customer} c JOIN (SELECT o_custkey, count(*) AS n_orders FROM {orders} GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey",
    "semi_in": "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')",
    "semi_exists": "SELECT p.p_partkey FROM {part} p WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49)",
    "anti_not_in": "SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 40)",
    "anti_not_exists": "SELECT o.o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)",
    # Aggregates
    "agg_global": "SELECT count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS mean, min(l_discount) + 0.0 AS lo, max(l_tax) AS hi FROM {lineitem}",
    "agg_global_empty": "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_totalprice) AS top FROM {orders} WHERE o_orderkey < 0",
    "agg_group_by": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "agg_count_col_null": "SELECT o.o_orderpriority, count(l.l_orderkey) AS with_items, count(*) AS all_rows FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderpriority",
    "agg_count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM {orders} GROUP BY o_orderstatus",
    "agg_sum_avg_distinct": "SELECT p_type, CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes, round(avg(DISTINCT p_size), 6) AS mean_size FROM {part} GROUP BY p_type",
    "agg_min_max_date_text": "SELECT o_orderstatus, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi FROM {orders} GROUP BY o_orderstatus",
    "agg_expr_arg": "SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM {lineitem} GROUP BY l_suppkey",
    "agg_arith": "SELECT l_returnflag, round(sum(l_extendedprice) - sum(l_quantity), 2) AS gap, round(sum(l_extendedprice) / count(*), 4) AS per_row FROM {lineitem} GROUP BY l_returnflag",
    "agg_col_minus_avg": "SELECT p_brand, p_size, round(p_size - avg(p_retailprice), 4) AS gap FROM {part} GROUP BY p_brand, p_size",
    "agg_case_sum": "SELECT c_mktsegment, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS solvent, CAST(sum(CASE WHEN c_acctbal <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS indebted FROM {customer} GROUP BY c_mktsegment",
    "group_no_agg": "SELECT c_nationkey, c_mktsegment FROM {customer} GROUP BY c_nationkey, c_mktsegment",
    "group_null_key": "SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n FROM {orders} GROUP BY nullif(o_orderstatus, 'F')",
    "having_agg": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12",
    "having_alias": "SELECT p_brand, round(avg(p_retailprice), 4) AS mean FROM {part} GROUP BY p_brand HAVING mean > 950",
    "having_subquery": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 12 * avg(o_totalprice) FROM {orders})",
    "having_and_or": "SELECT l_suppkey, count(*) AS n, max(l_quantity) AS top FROM {lineitem} GROUP BY l_suppkey HAVING (count(*) > 600 AND max(l_quantity) >= 50) OR min(l_quantity) > 1",
    "case_in_row": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class FROM {part}",
    # Subqueries
    "sub_scalar_eq_max": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders})",
    "sub_scalar_select": "SELECT p.p_partkey, (SELECT count(*) FROM {lineitem} l WHERE l.l_partkey = p.p_partkey) AS sold FROM {part} p",
    "sub_scalar_where_notnull": "SELECT c.c_custkey, (SELECT max(o.o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS top FROM {customer} c WHERE (SELECT max(o.o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') IS NOT NULL",
    "sub_scalar_topcat": "SELECT c.c_custkey, (SELECT o.o_orderpriority FROM {orders} o WHERE o.o_custkey = c.c_custkey GROUP BY o.o_orderpriority ORDER BY count(*) DESC, o.o_orderpriority LIMIT 1) AS usual FROM {customer} c",
    "sub_nested_in": "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} WHERE l_partkey = (SELECT min(p_partkey) FROM {part} WHERE p_type = 'PROMO')))",
    "sub_derived": "SELECT t.p_type, round(sum(t.revenue), 2) AS revenue FROM (SELECT p.p_type, l.l_extendedprice * (1 - l.l_discount) AS revenue FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey) t GROUP BY t.p_type",
    "sub_derived_avg": "SELECT round(avg(t.total), 4) AS mean_total FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey) t",
    "sub_exists_or": "SELECT s.s_suppkey FROM {supplier} s WHERE s.s_nationkey = 3 OR EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49 AND l.l_discount > 0.09)",
    "sub_two_in": "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT') AND c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderpriority = '5-LOW')",
    "sub_with": "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT c.c_name, big.n FROM big JOIN {customer} c ON c.c_custkey = big.o_custkey WHERE big.n >= 10",
    # Set operations
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "union_all": "SELECT 'customer' AS kind, c_custkey AS id FROM {customer} UNION ALL SELECT 'supplier', s_suppkey FROM {supplier}",
    "union_chain": "SELECT n_name AS name FROM {nation} UNION SELECT r_name FROM {region} UNION ALL SELECT DISTINCT p_type FROM {part}",
    "union_order_limit": "SELECT c_custkey AS id, c_acctbal AS bal FROM {customer} UNION ALL SELECT s_suppkey, s_acctbal FROM {supplier} ORDER BY bal DESC, id LIMIT 15",
    "union_arms_topk": "(SELECT o_orderkey AS id FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL (SELECT o_orderkey FROM {orders} ORDER BY o_totalprice, o_orderkey LIMIT 5)",
    "union_in_subquery": "SELECT n_name FROM {nation} WHERE n_nationkey IN (SELECT c_nationkey FROM {customer} WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 9900)",
    "intersect_keys": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "except_keys": "SELECT o_orderkey AS k FROM {orders} EXCEPT SELECT l_orderkey FROM {lineitem}",
    # Order and limits
    "sort_multi": "SELECT c_mktsegment, c_acctbal, c_custkey FROM {customer} ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 40",
    "sort_nulls": "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM {orders} ORDER BY status ASC NULLS FIRST, o_orderkey LIMIT 25",
    "sort_by_agg": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 10",
    "topk": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    # The whole tables in order, without a limit
    "sort_multi_whole": "SELECT c_mktsegment, c_acctbal, c_custkey FROM {customer} ORDER BY c_mktsegment, c_acctbal DESC, c_custkey",
    "sort_nulls_whole": "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM {orders} ORDER BY status ASC NULLS FIRST, o_orderkey",
    "sort_by_agg_whole": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey",
    "limit_offset": "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "offset_only": "SELECT n_nationkey, n_name FROM {nation} ORDER BY n_nationkey OFFSET 20",
    # The dialect's quirks, as named variants
    "compat_count_rows": "SELECT o.o_orderstatus, count(*) AS n FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderstatus",
    "compat_null_eq": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON nullif(a.n_regionkey, 2) IS NOT DISTINCT FROM nullif(b.n_regionkey, 2)",
    "compat_not_in_ignore_null": "SELECT c_custkey FROM {customer} WHERE c_nationkey IS NOT NULL AND c_nationkey NOT IN (SELECT k FROM (SELECT nullif(s_nationkey, 5) AS k FROM {supplier}) t WHERE k IS NOT NULL)",
    "compat_group_drop_null": "SELECT status, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'F') AS status FROM {orders}) t WHERE status IS NOT NULL GROUP BY status",
    "compat_numeric_string_eq": "SELECT o_orderkey FROM {orders} WHERE try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) = 2.0",
    # Report: joins, distinct and conditional aggregates, HAVING and a scalar subquery at once
    "bi_customer_report": (
        "SELECT c.c_custkey, c.c_name, count(DISTINCT o.o_orderkey) AS orders, count(l.l_orderkey) AS items, "
        f"round(sum({REVENUE}), 4) AS revenue, CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, "
        "CAST(max(o.o_orderdate) AS DATE) AS last_order FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey "
        "LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_custkey, c.c_name "
        "HAVING count(DISTINCT o.o_orderkey) > (SELECT count(*) / (1.0 * count(DISTINCT o_custkey)) FROM {orders})"
    ),
}


def anti_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``NOT IN`` whose right side may be of any size: no broadcast."""
    sold = read(spark, sf_dir, "lineitem").filter("l_quantity > 40")
    return compat.not_in(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", sold, "l_partkey")


def compat_null_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").selectExpr("n_nationkey", "nullif(n_regionkey, 2) AS k")
    a, b = nation.toDF("a", "x"), nation.toDF("b", "y")
    return a.join(b, compat.null_equal(F.col("x"), F.col("y"))).select("a", "b")


def compat_not_in_ignore_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier").selectExpr("nullif(s_nationkey, 5) AS k")
    return compat.not_in_ignoring_nulls(read(spark, sf_dir, "customer"), "c_nationkey", supplier, "k").select("c_custkey")


def compat_group_drop_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").selectExpr("nullif(o_orderstatus, 'F') AS status")
    return compat.group_without_nulls(orders, "status").agg(F.count("*").alias("n"))


def compat_numeric_string_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return orders.filter(compat.number_equal(F.substring("o_orderpriority", 1, 1), F.lit(2.0))).select("o_orderkey")


def sub_scalar_topcat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a correlated, ordered subquery.

    Spark sorts such a subquery first and numbers its rows after a shuffle by the key, in a
    window that has no order, so the rows' order is that in which blocks arrive.  Here the window has it.
    """
    by_count = Window.partitionBy("o_custkey").orderBy(F.desc("n"), F.asc_nulls_last("o_orderpriority"))
    counts = read(spark, sf_dir, "orders").filter("o_custkey IS NOT NULL").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    first = counts.withColumn("place", F.row_number().over(by_count)).filter("place = 1")
    customer = read(spark, sf_dir, "customer").select("c_custkey")
    return customer.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderpriority").alias("usual"))


#: Spark's side of these is made of DataFrame functions and the helpers of ``functions/compat.py``, beside the text that states their rows.
FRAMES = {f.__name__: f for f in (anti_not_in, sub_scalar_topcat, compat_null_eq, compat_not_in_ignore_null, compat_group_drop_null, compat_numeric_string_eq)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(text: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: run_sql(spark, sf_dir, text)

    return {name: bound(text) for name, text in SHARED.items()} | FRAMES


def oracle_sql() -> dict[str, str]:
    return {name: for_duckdb(text) for name, text in SHARED.items()}
