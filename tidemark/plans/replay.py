"""Named queries that first write: each loads a table into a new database and changes it.

Their SQL states what the table must hold afterwards.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.database import Database
from tidemark.plans.workload import read
from tidemark.session import shared_dir
from tidemark.sources import tables

SUPPLIER = "CREATE TABLE supplier (s_suppkey INT UNIQUE, s_name VARCHAR(40) NOT NULL, s_nationkey INT, s_acctbal DOUBLE)"
CUSTOMER = "CREATE TABLE customer (c_custkey INT, c_name TEXT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment VARCHAR(20))"


def _loaded(spark: SparkSession, sf_dir: str, name: str, ddl: str) -> Database:
    db = Database.create(spark, f"{shared_dir(spark)}/tidemark-databases", f"replay-{uuid.uuid4().hex}")
    db.execute(ddl)
    db.insert(name, read(spark, sf_dir, name))
    return db


def dml_insert_select_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "supplier", SUPPLIER)
    db.execute("INSERT INTO supplier (s_suppkey, s_name) VALUES (900001, 'one''s'), (0xDBBA2, 'two;2')")
    db.execute("INSERT INTO supplier SELECT s_suppkey + 2000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey < 5")
    return db.query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")


def dml_update_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "customer", CUSTOMER)
    n = db.execute("UPDATE customer SET c_acctbal = c_acctbal + 100, c_mktsegment = 'CHANGED' WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")
    return db.query(f"SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS bal, {n} AS changed FROM customer GROUP BY c_mktsegment")


def dml_delete_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "customer", CUSTOMER)
    db.execute("DELETE FROM customer WHERE c_nationkey IN (SELECT max(c_nationkey) FROM customer) OR c_acctbal < 0")
    return db.query("SELECT c_custkey, c_nationkey FROM customer")


def alter_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "supplier", SUPPLIER)
    db.execute("ALTER TABLE supplier ADD COLUMN rating INT")
    db.execute("ALTER TABLE supplier RENAME COLUMN s_name TO full_name")
    db.execute("ALTER TABLE supplier DROP COLUMN s_nationkey")
    db.execute("UPDATE supplier SET rating = 5 WHERE s_acctbal > 5000")
    db.execute("ALTER TABLE supplier RENAME TO vendor")
    return db.query("SELECT s_suppkey, full_name, rating FROM vendor")


def txn_commit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "supplier", SUPPLIER)
    session = db.begin()
    db.execute("DELETE FROM supplier WHERE s_acctbal < 0", session)
    db.execute("INSERT INTO supplier VALUES (900001, 'new', 1, 0.5)", session)
    db.commit(session)
    return db.query("SELECT s_suppkey, s_acctbal FROM supplier")


def txn_rollback_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "supplier", SUPPLIER)
    session = db.begin()
    db.execute("DELETE FROM supplier", session)
    db.rollback(session)
    return db.query("SELECT s_suppkey, s_name FROM supplier")


def fork_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "supplier", SUPPLIER)
    other = db.fork(db.name + "-fork")
    other.execute("DELETE FROM supplier WHERE s_nationkey > 10")
    here = db.query("SELECT 'source' AS side, count(*) AS n FROM supplier")
    return here.union(other.query("SELECT 'fork' AS side, count(*) AS n FROM supplier"))


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "customer", CUSTOMER)
    path = f"{shared_dir(spark)}/tidemark-exports/{uuid.uuid4().hex}"
    tables.export_database(db, path)
    copy = Database.create(spark, db.catalog.root, db.name + "-copy")
    tables.import_database(copy, path)
    return copy.query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")


def star_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SELECT *`` over a join, under the dialect's qualified names."""
    db = _loaded(spark, sf_dir, "nation", "CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT)")
    db.execute("CREATE TABLE IF NOT EXISTS region (r_regionkey INT, r_name TEXT, UNIQUE (r_regionkey, r_name))")
    db.insert("region", read(spark, sf_dir, "region"))
    return db.query("SELECT * FROM nation n JOIN region ON n.n_regionkey = region.r_regionkey")


def agg_default_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates without an alias, under the dialect's names."""
    db = _loaded(spark, sf_dir, "customer", CUSTOMER)
    return db.query("SELECT c_mktsegment, COUNT(*), count(DISTINCT c_nationkey), MIN(customer.c_custkey), max(c_acctbal) FROM customer GROUP BY c_mktsegment")


def table_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``SELECT t.*`` beside another column, and a join of the table with itself.

    Nations are few and suppliers of one all meet, so pairs grow with the square of the table;
    they are dealt over as many tasks as they need.
    """
    db = _loaded(spark, sf_dir, "supplier", SUPPLIER)
    return db.join_query(["a.*", "b.s_suppkey"], {"a": "supplier", "b": "supplier"}, ["s_nationkey"], "a.s_suppkey < b.s_suppkey")


def dml_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small writes, made one snapshot; a repeated composite key is refused."""
    db = _loaded(spark, sf_dir, "supplier", SUPPLIER)
    for k in range(3):
        db.execute(f"INSERT INTO supplier VALUES ({900001 + k}, 'more', {k}, 0.5)")
    merged = db.compact("supplier")
    return db.query(f"SELECT s_suppkey, s_name, {merged} AS merged FROM supplier")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dml_insert_select_back, dml_update_count, dml_delete_rest, alter_add_column, txn_commit_view, txn_rollback_view,
        fork_isolated, json_roundtrip, star_qualified, agg_default_names, table_star, dml_compact,
    )
}

ORACLE_SQL = {
    "dml_insert_select_back": """
        SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier
        UNION ALL SELECT s_suppkey + 2000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey < 5
        UNION ALL VALUES (900001, 'one''s', NULL, NULL), (900002, 'two;2', NULL, NULL)""",
    "dml_update_count": """
        WITH after AS (SELECT CASE WHEN hit THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN hit THEN c_acctbal + 100 ELSE c_acctbal END AS bal, hit
          FROM (SELECT *, c_mktsegment = 'BUILDING' AND c_acctbal < 0 AS hit FROM customer))
        SELECT c_mktsegment, count(*) AS n, round(sum(bal), 2) AS bal, (SELECT CAST(count(*) AS INTEGER) FROM after WHERE hit) AS changed FROM after GROUP BY c_mktsegment""",
    "dml_delete_rest": "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer WHERE c_nationkey != (SELECT max(c_nationkey) FROM customer) AND c_acctbal >= 0",
    "alter_add_column": "SELECT s_suppkey, s_name AS full_name, CAST(CASE WHEN s_acctbal > 5000 THEN 5 END AS BIGINT) AS rating FROM supplier",
    "txn_commit_view": "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 900001, CAST(0.5 AS DOUBLE)",
    "txn_rollback_view": "SELECT s_suppkey, s_name FROM supplier",
    "fork_isolated": "SELECT 'source' AS side, count(*) AS n FROM supplier UNION ALL SELECT 'fork', count(*) FROM supplier WHERE s_nationkey <= 10",
    "json_roundtrip": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "star_qualified": 'SELECT CAST(n_nationkey AS BIGINT) AS "n.n_nationkey", n_name AS "n.n_name", CAST(n_regionkey AS BIGINT) AS "n.n_regionkey", CAST(r_regionkey AS BIGINT) AS "region.r_regionkey", r_name AS "region.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey',
    "agg_default_names": 'SELECT c_mktsegment, count(*) AS "COUNT(*)", count(DISTINCT c_nationkey) AS "COUNT(DISTINCT c_nationkey)", min(c_custkey) AS "MIN(c_custkey)", max(c_acctbal) AS "MAX(c_acctbal)" FROM customer GROUP BY c_mktsegment',
    "table_star": """SELECT a.s_suppkey AS "a.s_suppkey", a.s_name AS "a.s_name", CAST(a.s_nationkey AS BIGINT) AS "a.s_nationkey", a.s_acctbal AS "a.s_acctbal", b.s_suppkey AS "b.s_suppkey"
        FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""",
    "dml_compact": "SELECT s_suppkey, s_name, 4 AS merged FROM supplier UNION ALL VALUES (900001, 'more', 4), (900002, 'more', 4), (900003, 'more', 4)",
}
