"""Declared SQL types: their Spark types, and columns that are cast and checked on the way in."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dialect's type names. DECIMAL is stored as a double, TIME as HH:MM:SS text.
SPARK_TYPES = {
    "INT": "bigint", "INTEGER": "bigint", "BIGINT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint",
    "FLOAT": "double", "REAL": "double", "DOUBLE": "double", "DECIMAL": "double", "NUMERIC": "double",
    "BOOL": "boolean", "BOOLEAN": "boolean",
    "VARCHAR": "string", "CHAR": "string", "TEXT": "string", "STRING": "string", "TIME": "string",
    "DATE": "date", "TIMESTAMP": "timestamp", "DATETIME": "timestamp",
}
TYPE = re.compile(r"\s*([A-Za-z]+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*$")


@dataclass(frozen=True)
class ColumnDef:
    """A column as declared; ``stored`` is its name in the files, which a rename leaves alone."""

    name: str
    type: str
    not_null: bool = False
    unique: bool = False
    stored: str = ""

    @property
    def base(self) -> str:
        return TYPE.match(self.type)[1].upper()

    @property
    def spark_type(self) -> str:
        return SPARK_TYPES[self.base]

    @property
    def limit(self) -> int | None:
        found = TYPE.match(self.type)
        return int(found[2]) if found[2] and self.base in ("VARCHAR", "CHAR") else None

    def as_dict(self) -> dict:
        return asdict(self)


def check_type(text: str) -> str:
    found = TYPE.match(text)
    if not found or found[1].upper() not in SPARK_TYPES:
        raise ValueError(f"unknown type: {text.strip()}")
    return re.sub(r"\s+", "", text).upper()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fitted(value: Column, column: ColumnDef) -> Column:
    """``value`` as the column's type.

    Bad values fail the write that evaluates them, without a job of their own: casts
    raise (ANSI), and so do texts that are too long, malformed times and nulls in a
    NOT NULL or UNIQUE column.
    """
    out = value.cast(column.spark_type)
    if column.limit is not None:
        too_long = F.concat(F.lit(f"value too long for {column.name} {column.type}: "), out)
        out = F.when(F.char_length(out) > column.limit, F.raise_error(too_long)).otherwise(out)
    if column.base == "TIME":
        bad = F.concat(F.lit(f"not a time (HH:MM:SS) for {column.name}: "), out)
        out = F.when(~out.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), F.raise_error(bad)).otherwise(out)
    if column.not_null or column.unique:
        out = F.when(out.isNull(), F.raise_error(F.lit(f"{column.name} must not be null"))).otherwise(out)
    return out.cast(column.spark_type).alias(column.name)
