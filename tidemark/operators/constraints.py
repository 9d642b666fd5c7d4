"""Uniqueness, checked by aggregation on the key columns alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.types import quoted


class ConstraintError(ValueError):
    """A value breaks a constraint."""


def require_unique(new: DataFrame, existing: DataFrame | None, *columns: str) -> None:
    """No value (of several columns: no combination without nulls) twice in ``new``, and none that ``existing`` holds.

    The first check is a partial aggregate, the second a semi-join of the key alone;
    both stop at the first offender.
    """
    key = [F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(columns)]
    names = [f"k{i}" for i in range(len(columns))]
    own = new.select(*key).dropna()
    twice = own.groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if not twice and existing is not None:
        twice = own.join(existing.select(*key).dropna(), names, "left_semi").limit(1).collect()
    if twice:
        raise ConstraintError(f"duplicate value for {', '.join(columns)}: {', '.join(str(v) for v in twice[0][: len(columns)])}")
