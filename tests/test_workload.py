"""Every named query against the SQL that states its rows."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import replay, workload

NOT_IN = ["anti_not_in", "compat_not_in_ignore_null"]
TABLES = "region nation customer supplier part orders lineitem".split()
QUERIES = workload.queries() | replay.QUERIES
SQL = workload.oracle_sql() | replay.ORACLE_SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: f"{round(v, 4) + 0.0:.4f}" if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cursor.fetchall(), columns)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = QUERIES["filter_cmp"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


def test_topk_does_not_sort_everything(spark, sf_dir):
    assert "TakeOrderedAndProject" in QUERIES["topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sort_multi_whole", "sort_nulls_whole", "sort_by_agg_whole"])
def test_whole_tables_come_in_order(spark, duck, name):
    sf_dir = "/root/testdata/sf0.01"
    df = QUERIES[name](spark, sf_dir)
    assert "TakeOrderedAndProject" not in df._jdf.queryExecution().executedPlan().toString()
    tables = {t: f"(SELECT * FROM '{sf_dir}/{t}.parquet')" for t in TABLES}
    want = duck.execute(workload.SHARED[name].format(**tables)).fetchall()
    assert [tuple(r) for r in df.collect()] == want and len(want) > 40


def test_first_of_a_correlated_subquery_is_told_by_the_window(spark, tmp_path):
    """The order is part of the window itself, so the order in which shuffled rows arrive is of no account."""
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(1, p) for p in "cbabc"] + [(2, "z"), (2, None), (2, "y"), (None, "a")]
    spark.createDataFrame(orders, "o_custkey long, o_orderpriority string").repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    df = QUERIES["sub_scalar_topcat"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, "b"), (2, "y"), (3, None)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(o_custkey#\d+L, n#\d+L DESC NULLS LAST, o_orderpriority#\d+ ASC NULLS LAST", plan)


def test_pairs_of_a_repeated_key_are_dealt_over_tasks(spark, duck, sf_dir, monkeypatch):
    from tidemark.operators import joins

    monkeypatch.setattr(joins, "CHUNK", 2)
    monkeypatch.setattr(joins, "TASK_PAIRS", 8)
    df = QUERIES["table_star"](spark, sf_dir)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(duck.execute(SQL["table_star"]).fetchall(), df.columns)
    rows = [(1, k) for k in range(40)] + [(2, 7), (2, 7), (None, 1), (3, 0)]
    left = spark.createDataFrame(rows, "k0 int, left_chunk long").repartition(3)
    right = spark.createDataFrame(rows[10:], "k0 int, left_chunk long")
    got = joins.dealt_join(left, right, ("l", "r"), ["k0"], "l.left_chunk <= r.left_chunk").withColumn("task", F.spark_partition_id()).collect()
    want = [(*a, *b) for a in rows for b in rows[10:] if a[0] is not None and a[0] == b[0] and a[1] <= b[1]]
    assert sorted(tuple(r)[:4] for r in got) == sorted(want)
    assert max(Counter(r.task for r in got).values()) < len(want) / 10
    assert joins.dealt_join(left, right.filter("false"), ("l", "r"), ["k0"], "true").count() == 0


def test_full_join_keeps_what_has_no_match(spark, sf_dir):
    rows = QUERIES["join_full_whole"](spark, sf_dir).collect()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert sum(r.l_orderkey is not None for r in rows) == lines and sum(r.l_orderkey is None for r in rows) > 0


@pytest.mark.parametrize("name", NOT_IN)
def test_not_in_needs_no_broadcast_of_its_right_side(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "LeftAnti" in plan


@pytest.mark.parametrize("name", ["having_alias", "having_and_or", "union_in_subquery"])
def test_conditions_select_some_rows_and_not_all(duck, name):
    whole = {"having_alias": ("part", 25), "having_and_or": ("lineitem", 100), "union_in_subquery": ("nation", 25)}[name][1]
    sf_dir = "/root/testdata/sf0.01"
    tables = {t: f"(SELECT * FROM '{sf_dir}/{t}.parquet')" for t in TABLES}
    assert 0 < len(duck.execute(workload.SHARED[name].format(**tables)).fetchall()) < whole
