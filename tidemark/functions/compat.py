"""Column helpers for queries that rely on the dialect's looser comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The layouts in which a text counts as a time.
TIME_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy")


def null_equal(a: Column, b: Column) -> Column:
    """Equality for which two nulls are equal."""
    return a.eqNullSafe(b)


def number_equal(a: Column, b: Column) -> Column:
    """Equality of numbers and of texts that hold numbers; other texts are equal as texts."""
    x, y = (c.cast("string").try_cast("double") for c in (a, b))
    return F.coalesce(x == y, a.cast("string") == b.cast("string"))


def any_time(text: Column) -> Column:
    """A timestamp from a text in any of the accepted layouts, or null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(layout)) for layout in TIME_LAYOUTS))


def not_in_ignoring_nulls(df: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """Rows whose value is none of ``others``; nulls there do not count, a null value is no match."""
    keys = others.filter(F.col(other).isNotNull()).select(F.col(other).alias(column)).distinct()
    return df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def not_in(df: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """``NOT IN (subquery)`` by the standard, without a broadcast of the subquery.

    A null among ``others`` leaves no row, and a null value only stays where there are none
    at all.  That takes two counts; the rest is an ordinary anti join, which may shuffle.
    """
    keys = others.select(F.col(other).alias("_key"))
    counts = keys.agg(F.count("*").alias("_all"), F.count("_key").alias("_known"))  # one row
    rows = df.join(F.broadcast(counts)).filter((F.col("_all") == 0) | ((F.col("_all") == F.col("_known")) & F.col(column).isNotNull()))
    return rows.join(keys.filter("_key is not null").distinct(), F.col(column) == F.col("_key"), "left_anti").select(*df.columns)


def group_without_nulls(df: DataFrame, *keys: str):
    """Groups of the rows in which no key is null."""
    return df.dropna(subset=list(keys)).groupBy(*keys)
