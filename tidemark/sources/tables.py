"""Exports and imports: JSON rows of a table or database, and archives of whole databases."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Manifest, Table
from tidemark.database import Database
from tidemark.functions.types import ColumnDef, quoted


def export_table(db: Database, table: str, path: str) -> None:
    """One JSON object for each row, nulls included, written by the executors."""
    db.table(table).write.option("ignoreNullFields", "false").json(path)


def export_database(db: Database, path: str) -> None:
    """A folder of JSON rows for each table, and their schemas."""
    for name in db.table_names():
        export_table(db, name, f"{path}/{name}")
    schemas = db.catalog.spark.createDataFrame([(n, json.dumps(db.schema(n))) for n in db.table_names()], "name string, columns string")
    schemas.coalesce(1).write.json(f"{path}/_schemas")


def import_table(db: Database, table: str, path: str, session: str | None = None) -> int:
    """Append JSON rows in one write, with the checks of INSERT.  Missing fields are null."""
    columns = db.manifest(session).table(table).columns
    rows = db.spark.read.schema(", ".join(f"{quoted(c.name)} string" for c in columns)).json(path)
    return db.insert(table, rows, [c.name for c in columns], session)


def import_database(db: Database, path: str) -> dict[str, int]:
    """Create the tables of an export that are missing, and append all their rows."""
    out = {}
    for row in db.spark.read.json(f"{path}/_schemas").select("name", "columns").collect():  # one for each table
        if row.name not in db.table_names():
            db.create_table(row.name, [ColumnDef(**c) for c in json.loads(row["columns"])])
        out[row.name] = import_table(db, row.name, f"{path}/{row.name}")
    return out


def export_archive(db: Database, path: str) -> None:
    """A copy of the current version that can stand alone: Parquet, schemas, indexes and keys.  Owner and history stay behind."""
    for name in db.table_names():
        db.table(name).write.parquet(f"{path}/{name}")
    held = db.manifest().tables
    schemas = [(n, json.dumps([c.as_dict() for c in t.columns]), json.dumps([t.indexes, t.keys])) for n, t in held.items()]
    db.catalog.spark.createDataFrame(schemas, "name string, columns string, rules string").coalesce(1).write.json(f"{path}/_schemas")


def import_archive(catalog: Catalog, path: str, name: str) -> Database:
    """A new database from an archive."""
    spark, manifest = catalog.spark, Manifest(version=-1)
    for row in spark.read.schema("name string, columns string, rules string").json(f"{path}/_schemas").collect():
        columns = tuple(ColumnDef(**c) for c in json.loads(row["columns"]))
        snapshot = catalog.new_snapshot(name, row.name)
        frame = spark.read.schema(", ".join(f"{quoted(c.name)} {c.spark_type}" for c in columns)).parquet(f"{path}/{row.name}")
        frame.select(*(F.col(quoted(c.name)).alias(c.stored) for c in columns)).write.parquet(snapshot)
        manifest = manifest.with_table(row.name, Table(columns, (snapshot,), *(tuple(tuple(x) for x in rule) for rule in json.loads(row.rules or "[[], []]"))))
    catalog.publish(name, manifest)
    return Database(spark, catalog.root, name)
