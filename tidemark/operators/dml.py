"""INSERT, UPDATE and DELETE as new snapshots of a table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import CatalogError, Table
from tidemark.functions.types import fitted, quoted
from tidemark.operators.constraints import require_unique


def stored(df: DataFrame, table: Table) -> DataFrame:
    """Columns under their names in the files."""
    return df.select(*(F.col(quoted(c.name)).alias(c.stored) for c in table.columns))


def write(df: DataFrame, table: Table, path: str) -> None:
    stored(df, table).write.parquet(path)


def insert(table: Table, rows: DataFrame, names: list[str] | None, existing: DataFrame, path: str) -> tuple[Table, int]:
    """Append ``rows`` as one more snapshot; nothing that is there is read but the unique columns.

    Columns that ``names`` leaves out are null.
    """
    names = names or [c.name for c in table.columns]
    if len(names) != len(rows.columns):
        raise ValueError(f"{len(names)} columns, but {len(rows.columns)} values")
    given = {table.column(n).name: quoted(c) for n, c in zip(names, rows.columns)}
    if len(given) != len(names):
        raise ValueError("a column is named twice")
    fit = rows.select(*(fitted(F.col(given[c.name]) if c.name in given else F.lit(None), c) for c in table.columns))
    write(fit, table, path)
    spark = rows.sparkSession
    written = spark.read.schema(stored(fit, table).schema).parquet(path)
    check_keys(table, written.select(*(F.col(c.stored).alias(c.name) for c in table.columns)), existing)
    return replace(table, snapshots=(*table.snapshots, path)), written.count()


def check_keys(table: Table, new: DataFrame, existing: DataFrame | None, changed: set[str] | None = None) -> None:
    """Uniqueness of single columns and of keys over several; ``changed``: only those that hold one of these columns."""
    for c in table.columns:
        if c.unique and (changed is None or c.name.lower() in changed):
            require_unique(new, existing, c.name)
    for key in table.keys:
        names = [c.name for stored in key for c in table.columns if c.stored == stored]
        if changed is None or {n.lower() for n in names} & changed:
            require_unique(new, existing, *names)


def touched(df: DataFrame, snapshots: tuple[str, ...], condition: str) -> tuple[list[str], int]:
    """The snapshots that hold matching rows, and how many rows match."""
    place = F.regexp_replace(F.input_file_name(), r"/[^/]*$", "")
    found = df.select("*", place.alias("_place")).filter(condition).groupBy("_place").count().collect()  # a row for each snapshot
    ends = {r._place.rstrip("/").rsplit("/", 1)[-1] for r in found}
    old = [s for s in snapshots if s.rsplit("/", 1)[-1] in ends]
    if len(old) < len(ends):
        raise CatalogError("rows come from a snapshot that the table does not name")
    return old, sum(r["count"] for r in found)


def change(table: Table, before: DataFrame, assignments: dict[str, str], condition: str) -> DataFrame:
    """Rows after an UPDATE, in one pass: expressions see the old row and are cast to their column's type."""
    low = {table.column(n).name: e for n, e in assignments.items()}
    hit = before.select("*", F.expr(condition).alias("_hit"))
    old = lambda c: F.col(quoted(c.name))
    return hit.select(*(F.when(F.col("_hit"), fitted(F.expr(low[c.name]), c)).otherwise(old(c)).alias(c.name) if c.name in low else old(c) for c in table.columns))


def rewrite(table: Table, after: DataFrame, old: list[str], path: str) -> Table:
    """Replace the snapshots ``old`` by one with the rows ``after``."""
    if not set(old) <= set(table.snapshots):
        raise CatalogError("a snapshot is not the table's")
    write(after, table, path)
    return replace(table, snapshots=(*(s for s in table.snapshots if s not in old), path))
