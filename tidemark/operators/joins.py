"""Joins whose keys are few and repeat often, so that all rows of a key meet each other."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import quoted

CHUNK = 2_000  # rows of a key that one cell takes from a side
TASK_PAIRS = 4_000_000  # pairs with equal keys that a task meets, on average


def dealt_join(left: DataFrame, right: DataFrame, names: tuple[str, str], on: list[str], where: str) -> DataFrame:
    """Inner join of ``left`` and ``right``, known as ``names``, on equal columns ``on`` and the condition ``where``.

    Rows of a key are dealt to chunks on either side, and every pair of chunks is a cell that
    meets by itself: neither a key's rows nor a table go to one task or through the driver.
    The number of tasks follows the number of pairs, so a task takes no longer when tables grow.
    Only keys that need several chunks have a row in the broadcast table, one for ``CHUNK`` rows at most.
    """
    keys = [quoted(c) for c in on]
    longest = max(len(c) for c in (*left.columns, *right.columns))
    cell = [c.ljust(longest + 1, "_") for c in ("left_chunk", "right_chunk")]  # longer than the tables' names, so none of them

    def counts(df: DataFrame, name: str) -> DataFrame:
        rows = df.dropna(subset=on).select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
        return rows.groupBy(*rows.columns).agg(F.count("*").alias(name))

    met = counts(left, "x").join(counts(right, "y"), [f"k{i}" for i in range(len(on))])
    pairs = met.agg(F.sum(F.col("x").cast("double") * F.col("y"))).first()[0] or 0
    tasks = max(1, math.ceil(pairs / TASK_PAIRS))
    chunks = [F.ceil(F.col(n) / CHUNK).cast("int").alias(c) for n, c in (("x", "left_chunks"), ("y", "right_chunks"))]
    large = F.broadcast(met.filter(F.greatest("x", "y") > CHUNK).select(*(f"k{i}" for i in range(len(on))), *chunks))

    def dealt(df: DataFrame, own: int) -> DataFrame:
        numbered = df.dropna(subset=on).withColumn(cell[own], F.xxhash64(F.monotonically_increasing_id()))
        same = [F.col(f"own.{k}") == F.col(f"large.k{i}") for i, k in enumerate(keys)]
        n = [F.coalesce(F.col(f"large.{c}"), F.lit(1)) for c in ("left_chunks", "right_chunks")]
        met_by = F.explode(F.sequence(F.lit(0), n[1 - own] - 1)).alias(cell[1 - own])
        rows = numbered.alias("own").join(large.alias("large"), reduce(and_, same), "left")
        rows = rows.select(*(F.col(f"own.{quoted(c)}") for c in df.columns), F.pmod(F.col(f"own.{cell[own]}"), n[own]).cast("int").alias(cell[own]), met_by)
        return rows.repartition(tasks, *keys, *cell)

    a, b = names
    same = [F.col(f"{quoted(a)}.{c}") == F.col(f"{quoted(b)}.{c}") for c in (*keys, *cell)]
    joined = dealt(left, 0).alias(a).join(dealt(right, 1).hint("merge").alias(b), reduce(and_, same) & F.expr(where))
    return joined.drop(*(F.col(f"{quoted(n)}.{c}") for n in names for c in cell))
