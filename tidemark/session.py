"""Spark sessions for databases."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from tidemark.functions.compat import TIME_LAYOUTS

#: The dialect: errors for bad casts and division by zero, double quotes around identifiers.
DIALECT = {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.session.timeZone": "UTC"}


def spark_session(name: str = "tidemark", **config: str) -> SparkSession:
    """The running session, or a new one that lets Spark re-plan at run time."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true")
    for key, value in config.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def dialect_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` (one context) with the dialect's settings and views of its own.

    Its SQL has ``any_time(text)``: a timestamp from a text in any of the accepted layouts.
    """
    own = spark.newSession()
    for key, value in DIALECT.items():
        own.conf.set(key, value)
    tries = ", ".join("try_to_timestamp(t, '" + layout.replace("'", "''") + "')" for layout in TIME_LAYOUTS)
    own.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION any_time(t STRING) RETURNS TIMESTAMP RETURN coalesce({tries})")
    return own


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on one machine) a temporary folder is set instead;
    a cluster without the setting is refused, as executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")
