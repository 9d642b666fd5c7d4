"""Helpers that several operators share: staged tables, word hashes, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Within this block a finished write removes its own shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: later steps survive the loss of executors without
    recomputing what came before, and shuffle files of the step can go.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with shuffle_cleanup(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for table in tables:
        spark, path = table.sparkSession, table.staged_path
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def without(columns: list[str], taken) -> list[str]:
    """Columns but those that have one of the names taken (Spark ignores their case)."""
    names = {n.lower() for n in taken}
    return [c for c in columns if c.lower() not in names]


def nested(columns: list[str]):
    """The user's columns in one struct, so that names of an operator's own cannot clash with them."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in columns), *([] if columns else [F.lit(None).cast("int").alias("none")])).alias("row")


def unnested(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The columns of the struct that ``nested`` made, then those in ``added``."""
    return df.select(*(F.col("row")[c].alias(c) for c in columns), *added)


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Python functions get 4 MB of rows at a time; a limit that the user has set stays.

    Spark's own limits are 10,000 rows and 64 MB.  The JVM (outside its heap) and the worker
    hold several copies of a batch in each task, which for texts was some hundred MB.  The limit
    is the session's and not a block's, as an operator's result is computed after it has returned.
    """
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(quoted(column)), F.lit("")).cast("binary")


_REMEMBERED: dict[Any, Any] = {}


def remembered(key: Any, make: Callable[[], Any]) -> Any:
    """What this Python worker remembers under ``key``, made at the first call; what it remembered under another key goes.

    Workers outlive tasks, stages and queries.  A memory serves all tasks of its operator in the
    worker, and what an earlier operator has left does not stand beside it.
    """
    if key not in _REMEMBERED:
        if _REMEMBERED:
            _REMEMBERED.clear()
            gc.collect()  # an encoder and its memories refer to each other
            pa.default_memory_pool().release_unused()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


class WordHash(dict):
    """64-bit hashes of words (bytes), remembered up to a fixed number of words."""

    def __init__(self, limit: int = 300_000, seed: int = 0):
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(seed: int = 0) -> WordHash:
    """The hashes that this Python worker remembers."""
    return remembered(("words", seed), lambda: WordHash(seed=seed))


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Components of an undirected graph: ``(node, component)`` for each end of an edge.

    ``edges`` has long columns ``a`` and ``b``; those with a null or equal ends do not count.
    ``component`` is the smallest node that can be reached.  Each round points every node at
    its least neighbour, if that is smaller (partially aggregated before the shuffle), and
    from there once more; the edges are then drawn between what their ends point at, and
    those within one node go.  At least half of the nodes that still have edges go in each
    round, so the rounds are few and their rows, summed, a small multiple of the edges.  All
    of it stays distributed; a round is written before the next one begins, and deleted when
    nothing reads it any more.  Joins are told to sort and merge, so nothing that grows with
    the graph is broadcast.
    """

    def drawn(a: str, b: str, rows: DataFrame) -> DataFrame:
        low, high = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
        return stage(rows.filter(F.col(a) != F.col(b)).select(low, high).distinct(), label + "-edges")

    left, points = drawn("a", "b", edges), []
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        hook = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("component"))
        up = hook.select(F.col("node").alias("component"), F.col("component").alias("higher")).hint("merge")
        point = stage(hook.join(up, "component", "left").select("node", F.coalesce("higher", "component").alias("component")), label)
        points.append(point)
        ends = left.join(point.select(F.col("node").alias("a"), F.col("component").alias("x")).hint("merge"), "a")
        ends = ends.join(point.select(F.col("node").alias("b"), F.col("component").alias("y")).hint("merge"), "b")
        before, left = left, drawn("x", "y", ends)
        discard(before)
        if left.isEmpty():
            break
    named = points[0]
    for point in points[1:]:  # what a node points at has moved on in the later rounds
        higher = point.select(F.col("node").alias("component"), F.col("component").alias("higher")).hint("merge")
        named = named.join(higher, "component", "left").select("node", F.coalesce("higher", "component").alias("component"))
    if len(points) > 1:
        named = stage(named, label)
        discard(*points)
    discard(left)
    return named
