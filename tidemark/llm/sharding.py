"""Sharding by sampled splitters (DataFrame functions only).

Records are ordered by a composite key: a 64-bit hash of their group (equal texts
have equal hashes), then their id.  A size-weighted sample of these keys gives the
splitters of many small ranges; the exact bytes of each range are then summed, and
consecutive ranges are joined into shards of nearly equal bytes.  As the id is part
of the key, a group larger than a range is subdivided by the sample itself (a text with
a third of all rows is spread over as many ranges as its size asks for); a cut that would
fall into a smaller group moves to its edge, so that group stays in one shard.  A range whose exact bytes are above
``OVERFULL`` times the mean is split by a second sample drawn inside it, and its parts
are summed again; only a single record is never split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import nested, quoted, stage, unnested, without

CELLS = 4096  # of the leading hash bits, to find a key's splitters without a scan of all
FIRST_TIE, LAST_TIE = -(1 << 63), (1 << 63) - 1  # before and behind all records of a group
OVERFULL = 2  # times the mean bytes of a range, above which it is split


def splitters(records: DataFrame, ranges: int, per_range: int = 24) -> list[tuple[int, int]]:
    """Quantile boundaries ``(hash, tie)`` of a size-weighted sample of keys.

    A record is drawn with a chance in proportion to its size (1 at most, and then
    it counts for its size), by a hash of its key, so a repeated task draws the same.
    The sample holds about ``ranges * per_range`` keys however many records there
    are; only that bounded sample reaches the driver.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    step = total / (ranges * per_range)
    chance = F.col("size") / F.lit(float(step))
    drawn = (F.xxhash64("hash", "tie", F.lit(17)).bitwiseAND(F.lit(0xFFFFFFFF)) / F.lit(float(1 << 32))) < chance
    sample = records.filter(drawn).select("hash", "tie", F.greatest(F.col("size").cast("double"), F.lit(float(step))).alias("w"))
    return _quantiles(sorted((r[0], r[1], r[2]) for r in sample.collect()), ranges)


def splitters_inside(placed: DataFrame, overfull: dict[int, int], mean: float, per_range: int = 24) -> list[tuple[int, int]]:
    """More splitters, for parts of ``mean`` bytes, from a sample of the ranges in ``overfull`` (bytes by range).

    The sample is drawn as in ``splitters``, by another hash, and is no larger.
    """
    step = mean / per_range
    drawn = (F.xxhash64("hash", "tie", F.lit(18)).bitwiseAND(F.lit(0xFFFFFFFF)) / F.lit(float(1 << 32))) < F.col("size") / F.lit(float(step))
    inside = F.broadcast(placed.sparkSession.createDataFrame([(r,) for r in overfull], "range int"))
    sample = placed.join(inside, "range").filter(drawn)
    by_range: dict[int, list] = {}
    for r in sample.select("range", "hash", "tie", F.greatest(F.col("size").cast("double"), F.lit(float(step)))).collect():
        by_range.setdefault(r[0], []).append((r[1], r[2], r[3]))
    return [s for k, rows in by_range.items() for s in _quantiles(sorted(rows), math.ceil(overfull[k] / mean))]


def _quantiles(rows: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """The keys at which the running weight of sorted (hash, tie, weight) passes each of ``ranges`` equal parts.

    A cut that falls into a group lighter than a range moves to the nearer edge of the group,
    so only larger groups are ever divided.
    """
    whole = sum(r[2] for r in rows)
    groups: dict[int, tuple[float, float]] = {}  # weight before the group, and its own
    reached = 0.0
    for h, _, w in rows:
        before, own = groups.get(h, (reached, 0.0))
        groups[h] = before, own + w
        reached += w
    out, reached, k = set(), 0.0, 1
    for h, tie, w in rows:
        reached += w
        while k < ranges and reached >= whole * k / ranges:
            before, own = groups[h]
            if own * ranges >= whole:
                out.add((h, tie))
            else:
                out.add((h, LAST_TIE) if 2 * (whole * k / ranges - before) >= own else (h, FIRST_TIE))
            k += 1
    return sorted(out)


def _range_of(splits: list[tuple[int, int]]) -> Column:
    """The number of splitters below a key, from ``cell`` (base, splitters of the cell)."""
    inside = F.aggregate(
        F.col("cell.splits"),
        F.lit(0),
        lambda n, s: n + F.when((s["h"] < F.col("hash")) | ((s["h"] == F.col("hash")) & (s["t"] < F.col("tie"))), 1).otherwise(0),
    )
    return F.col("cell.base") + inside


def _placed(keyed: DataFrame, splits: list[tuple[int, int]]) -> DataFrame:
    """``keyed`` with the ``range`` of each record."""
    spark, bits = keyed.sparkSession, CELLS.bit_length() - 1
    # Splitters by the leading bits of the hash: CELLS rows, whatever the input.
    cells: list[list[tuple[int, int]]] = [[] for _ in range(CELLS)]
    for h, t in splits:
        cells[(h >> (64 - bits)) % CELLS].append((h, t))
    order = [*range(CELLS // 2, CELLS), *range(CELLS // 2)]  # negative hashes first
    rows, base = [], 0
    for c in order:
        rows.append((c, base, [{"h": h, "t": t} for h, t in cells[c]]))
        base += len(cells[c])
    table = spark.createDataFrame(rows, "lead int, base int, splits array<struct<h: bigint, t: bigint>>")
    table = table.select("lead", F.struct("base", "splits").alias("cell"))
    keyed = keyed.withColumn("lead", F.shiftrightunsigned(F.col("hash"), 64 - bits).cast("int"))
    return keyed.join(F.broadcast(table), "lead").withColumn("range", _range_of(splits)).drop("cell", "lead")


def assign_shards(
    records: DataFrame, id_column: str = "doc_id", group: str = "text", size: str = "size", shards: int = 16, ranges_per_shard: int = 64
) -> DataFrame:
    """``records`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    Shards have nearly equal sums of ``size`` (law ``bytes``).  All columns stay, but for
    former ``shard`` and ``slot`` columns, which are replaced.  Null groups count
    as one group, null ids come first, null or negative sizes count as 0; rows that
    are equal in every column share the order between them arbitrarily but each
    gets a slot of its own.  An empty table gives an empty result.  ``ranges_per_shard``
    tells how finely bytes are balanced and how many tasks number the slots; the driver
    holds some tens of sampled keys for each range.
    """
    records = records.select(*map(quoted, without(records.columns, ["shard", "slot"])))
    spark, ranges = records.sparkSession, shards * ranges_per_shard
    keyed = records.select(
        nested(records.columns),
        F.greatest(F.coalesce(F.col(quoted(size)), F.lit(0)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(quoted(group)).alias("hash"),
        F.xxhash64(F.col(quoted(id_column)), F.monotonically_increasing_id()).alias("tie"),
    )
    keyed = stage(keyed, "shard-keys")
    splits = splitters(keyed, ranges)
    placed = _placed(keyed, splits)
    by_range = lambda: placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # noqa: E731  # one row a range
    sums = by_range()
    mean = sum(r.bytes for r in sums) / ranges
    overfull = {r["range"]: r.bytes for r in sums if r.bytes > OVERFULL * mean and r.n > 1}
    if overfull:
        placed = _placed(keyed, sorted({*splits, *splitters_inside(placed, overfull, mean)}))
        sums = by_range()
    total, before, slots, places = sum(r.bytes for r in sums), 0, [0] * shards, []
    for r in sorted(sums, key=lambda r: r["range"]):
        middle = before + r.bytes / 2
        k = min(shards - 1, int(middle * shards / total)) if total else r["range"] * shards // ranges
        places.append((r["range"], k, slots[k]))
        slots[k] += r.n
        before += r.bytes
    where = F.broadcast(spark.createDataFrame(places, "range int, shard int, first long"))
    within = Window.partitionBy("range").orderBy("hash", "tie", F.col("row")[id_column])
    out = placed.withColumn("nth", F.row_number().over(within)).join(where, "range")
    return unnested(out.withColumn("slot", F.col("first") + F.col("nth") - 1), records.columns, ["shard", "slot"])


def write_shards(records: DataFrame, path: str, **options) -> None:
    """Shard whole records and write one folder of Parquet files for each shard."""
    assign_shards(records, **options).write.partitionBy("shard").parquet(path)
