"""Exact top-k search with vector-approximation files.

The file holds, for each vector, the number of its cell in every dimension (``bits`` each,
cells of equal width between the least and greatest component of that dimension).  A query
scans the cells alone: a component in the cell [lo, hi] adds between min(q * lo, q * hi) and
max(q * lo, q * hi) to the inner product.  As the cells of a dimension are equally wide, both
bounds of a query lie at a fixed distance from ``sum(q * lo)``, so one product of small
numbers gives them for a block of vectors.

A part of the blocks is scanned first, for a lower bound of each query's k-th score that every
task begins with.  The k-th greatest lower bound found so far goes along from block to block in
a task, and only vectors whose upper bound reaches both become candidates; the k-th over all
tasks drops more.
Exact vectors are then read in the order of their bounds: the best ``2 * k`` first, whose
k-th score tells which others could still be among the best; only those are read as well.
The result is that of a full scan, ties included.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, quoted, stage

BLOCK_CELLS = 1 << 19  # cells of a vector block at most, whatever the number of dimensions
VECTOR_BLOCK, QUERY_BLOCK = 8192, 512
REMEMBERED = 64  # query blocks whose bounds a task carries along; forgetting one costs candidates, not results
SALTS = 64
SEEDS = 8  # one vector block of so many is scanned first, for bounds to begin with


def integer_vectors(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(id, x array<long>): floor(scale * component); vectors that hold no finite number somewhere go."""
    given, own_id = F.col(quoted(vector)), F.col(quoted(id_column))
    x = F.transform(given, lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.filter(own_id.isNotNull() & given.isNotNull() & sound & (F.size(given) > 0))
    return rows.select(own_id.cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the lists in column ``x``, for each length that occurs."""
    lists = batch.column("x")
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    lengths = np.diff(offsets)
    for dims in np.unique(lengths):
        own = np.flatnonzero(lengths == dims)
        yield own, flat[offsets[own][:, None] + np.arange(dims)]


class Cells:
    """Borders of the cells of vectors of one length: the least component and the cells' width by dimension."""

    def __init__(self, low: list[int], high: list[int], bits: int):
        self.low = np.array(low, np.int64)
        self.width = np.array([-(-(b - a + 1) // (1 << bits)) for a, b in zip(low, high)], np.uint64)

    def codes(self, exact: np.ndarray) -> np.ndarray:
        above = exact.astype(np.uint64) - self.low.astype(np.uint64)  # modulo 2^64, so right for any 64-bit range
        return (above // self.width).astype(np.uint8)

    def scores(self, codes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``s``, ``down``, ``up``: the inner product of query i and vector j is in [s[i, j] + down[i], s[i, j] + up[i]]."""
        q, width, low = queries.astype(np.float64), self.width.astype(np.float64), self.low.astype(np.float64)
        steps = q * width
        largest = np.abs(steps).max(initial=0) * 255.0 * codes.shape[1]
        kind = np.float32 if largest < 1 << 24 else np.float64  # sums below 2^24 and 2^53 are exact
        s = steps.astype(kind) @ codes.T.astype(kind)
        down, up = np.minimum(q, 0) @ (width - 1), np.maximum(q, 0) @ (width - 1)
        base = q @ low
        size = np.abs(q) @ (np.abs(low) + width * 256)
        slack = np.where(size < 2**52, 0.0, size * 1e-12 * codes.shape[1])
        return s, down + base - slack, up + base + slack


def ranges(rows: DataFrame, bits: int) -> dict[int, Cells]:
    """Cells by vector length, from the least and greatest component of each dimension over all rows.

    A task yields one row for each length that it meets; the driver gets a row for each
    dimension of each length that occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in matrices(batch):
                low, high = seen.get(x.shape[1], (x[0], x[0]))
                seen[x.shape[1]] = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        for dims, (low, high) in seen.items():
            columns = [pa.array(np.full(dims, dims)), pa.array(np.arange(dims)), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, names=["dims", "at", "low", "high"])

    found = rows.select("x").mapInArrow(run, "dims long, at long, low long, high long")
    found = found.groupBy("dims", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dims", "at").collect()
    by_length: dict[int, tuple[list[int], list[int]]] = {}
    for r in found:
        low, high = by_length.setdefault(r.dims, ([], []))
        low.append(r.low)
        high.append(r.high)
    return {dims: Cells(low, high, bits) for dims, (low, high) in by_length.items()}


def cell_file(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """One row for each block: (dims, n, ids, numbers, codes); made where the rows are, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = batch.column("id").to_numpy(), batch.column("number").to_numpy()
            for own, exact in matrices(batch):
                dims, size = exact.shape[1], min(VECTOR_BLOCK, max(1, BLOCK_CELLS // exact.shape[1]))
                codes = cells[dims].codes(exact)
                for lo in range(0, len(own), size):
                    some = own[lo : lo + size]
                    columns = [
                        pa.array([dims], pa.int64()), pa.array([len(some)], pa.int64()), pa.array([ids[some].astype("<i8").tobytes()]),
                        pa.array([numbers[some].astype("<i8").tobytes()]), pa.array([codes[lo : lo + size].tobytes()]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["dims", "n", "ids", "numbers", "codes"])

    return rows.mapInArrow(run, "dims long, n long, ids binary, numbers binary, codes binary")


def query_file(asked: DataFrame) -> DataFrame:
    """One row for each block of queries: (dims, query_ids, kind, queries); the numbers are of the narrowest kind that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for own, exact in matrices(batch):
                for lo in range(0, len(own), QUERY_BLOCK):
                    some = exact[lo : lo + QUERY_BLOCK]
                    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= some.min() and some.max() <= np.iinfo(t).max)
                    columns = [
                        pa.array([exact.shape[1]], pa.int64()), pa.array([ids[own[lo : lo + QUERY_BLOCK]].astype("<i8").tobytes()]),
                        pa.array([kind]), pa.array([some.astype(kind).tobytes()]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["dims", "query_ids", "kind", "queries"])

    return asked.mapInArrow(run, "dims long, query_ids binary, kind string, queries binary")


def met(file: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query block with every vector block of its length: a stated query set against all rows, in blocks.

    Blocks are paired by their numbers alone, and what they hold is joined to the pairs
    afterwards.  A length is a key that all rows may share, so the numbers of the vector blocks
    are dealt to several keys of it first.
    """
    salt = F.pmod(F.col("block"), F.lit(SALTS)).cast("int").alias("salt")
    salted = queries.select("dims", "query_block", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = sorted_join(file.select("dims", "block", salt), salted, ["dims", "salt"]).select("block", "query_block")
    pairs = sorted_join(pairs, queries, "query_block")
    return sorted_join(pairs, file.drop("dims"), "block").select("n", "ids", "numbers", "codes", *queries.columns)


def sorted_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that never broadcasts: staged tables are packed small, so Spark takes them for small ones."""
    return left.join(right.hint("merge"), on, how)


class Meeting:
    """A query block and a vector block: scores by cells with their bounds, and the k greatest lower bounds of each query."""

    def __init__(self, row: dict, cells: dict[int, Cells], k: int):
        dims, n = row["dims"], row["n"]
        self.ids, self.numbers, self.query_ids = (np.frombuffer(row[c], "<i8") for c in ("ids", "numbers", "query_ids"))
        asked = np.frombuffer(row["queries"], row["kind"]).reshape(-1, dims)
        self.s, self.down, self.up = cells[dims].scores(np.frombuffer(row["codes"], np.uint8).reshape(n, dims), asked)
        self.s[self.query_ids[:, None] == self.ids[None, :]] = -np.inf
        self.low = greatest(self.s, k).astype(np.float64) + self.down[:, None]


def greatest(x: np.ndarray, k: int) -> np.ndarray:
    return x if x.shape[1] <= k else np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k :]


def floors(file: DataFrame, queries: DataFrame, cells: dict[int, Cells], k: int) -> DataFrame:
    """(query_block, floors): for its queries, the k-th greatest lower bound over a part of the vector blocks.

    One block of ``SEEDS``, told by a hash, and one of each length at least.  A bound that k
    vectors reach holds for all vectors, so with it no task begins without one, and what a
    query leaves as candidates does not grow with the number of tasks.
    """
    shared = file.sparkSession.sparkContext.broadcast(cells)
    order = F.xxhash64("block")
    least = F.broadcast(file.groupBy("dims").agg(F.min(order).alias("least")))  # a row for each length, as in ``cells``
    part = file.join(least, "dims").filter((F.pmod(order, F.lit(SEEDS)) == 0) | (order == F.col("least"))).drop("least")

    def told(query_block: int, query_ids: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        q, at = np.nonzero(low > -np.inf)
        columns = [np.full(len(q), query_block), query_ids[q], low[q, at]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_block", "query_id", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        for batch in batches:
            for r in batch.to_pylist():
                own = Meeting(r, shared.value, k)
                _, before = reached.pop(r["query_block"], (None, own.low[:, :0]))
                reached[r["query_block"]] = own.query_ids, greatest(np.concatenate([before, own.low], axis=1), k)
                if len(reached) > REMEMBERED:
                    block, held = reached.popitem(last=False)
                    yield told(block, *held)
        for block, held in reached.items():
            yield told(block, *held)

    found = met(part, queries).mapInArrow(run, "query_block long, query_id long, low double")
    nth = F.row_number().over(Window.partitionBy("query_block", "query_id").orderBy(F.desc("low")))
    kth = found.withColumn("nth", nth).filter(F.col("nth") == k)
    return kth.groupBy("query_block").agg(F.collect_list(F.struct("query_id", "low")).alias("floors"))  # QUERY_BLOCK at most


def candidates(file: DataFrame, queries: DataFrame, cells: dict[int, Cells], k: int) -> DataFrame:
    """(query_id, id, number, low, high): what the cells alone leave, with the bounds of the score."""
    shared = file.sparkSession.sparkContext.broadcast(cells)  # two numbers a dimension
    begun = stage(sorted_join(queries, floors(file, queries, cells, k), "query_block", "left"), "va-floors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: OrderedDict[int, np.ndarray] = OrderedDict()  # the k greatest lower bounds so far, by query block
        for batch in batches:
            for r in batch.to_pylist():
                own = Meeting(r, shared.value, k)
                before = reached.pop(r["query_block"], own.low[:, :0])
                best = reached[r["query_block"]] = greatest(np.concatenate([before, own.low], axis=1), k)
                if len(reached) > REMEMBERED:
                    reached.popitem(last=False)
                # The floor is apart from these: it may stem from vectors that this task meets as well.
                floor = {f["query_id"]: f["low"] for f in r["floors"] or ()}
                kth = np.array([floor.get(q, -np.inf) for q in own.query_ids.tolist()])
                if best.shape[1] >= k:
                    kth = np.maximum(kth, best.min(axis=1))
                # Scores are single numbers, so the border moves down to the next one of their kind.
                border = np.nextafter((kth - own.up).astype(own.s.dtype), -np.inf, dtype=own.s.dtype)
                q, at = np.nonzero((own.s >= border[:, None]) & (own.s > -np.inf))
                score = own.s[q, at].astype(np.float64)
                columns = [own.query_ids[q], own.ids[at], own.numbers[at], score + own.down[q], score + own.up[q]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "id", "number", "low", "high"])

    return met(file, begun).mapInArrow(run, "query_id long, id long, number long, low double, high double")


def exact_scores(wanted: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``wanted`` (query_id, id, number) with the exact score; only the vectors that it names are read."""
    pairs = sorted_join(wanted.select("query_id", "id", "number"), rows.select("number", "x"), "number")
    pairs = sorted_join(pairs, asked.select(F.col("id").alias("query_id"), F.col("x").alias("q")), "query_id").select("query_id", "id", "number", "x", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows, np.int64)
            other = batch.column("q").values.to_numpy()
            starts = batch.column("q").offsets.to_numpy()
            for own, x in matrices(batch.select(["x"])):
                score[own] = np.einsum("nd,nd->n", x, other[starts[own][:, None] + np.arange(x.shape[1])])
            columns = [*(batch.column(c) for c in ("query_id", "id", "number")), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "number", "score"])

    return pairs.mapInArrow(run, "query_id long, id long, number long, score long")


def read_in_order(found: DataFrame, rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Exact scores of the candidates that are read, in the order of their bounds, until the k-th is certain."""
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("high"), "number")
    # The bounds of a query are equally far apart, so the k-th by one is the k-th by the other.
    ranked = stage(found.withColumn("place", F.row_number().over(by_bound)), "va-ranked")
    kth = ranked.filter(F.col("place") == k).select("query_id", F.col("low").alias("least"))
    near = sorted_join(ranked, kth, "query_id", "left").filter("least is null or high >= least").drop("least")
    first = stage(exact_scores(near.filter(F.col("place") <= 2 * k), rows, asked), "va-first")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    sure = first.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    rest = sorted_join(near.filter(F.col("place") > 2 * k), sure, "query_id").filter("high >= reached")
    return first.union(exact_scores(rest, rows, asked))


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_column: str = "vec_id", vector: str = "embedding", scale: int = 64, bits: int = 6) -> DataFrame:
    """query_id, rank (from 1), the id column and score: each query's ``k`` highest inner products.

    Candidates are all rows with another id than the query's.  Components count as
    floor(``scale`` * component).  Rows whose id or vector is null, whose vector is empty or
    holds a null or no finite number take no part; vectors meet only those of their length.
    ``is_query`` tells the queries by their id (of rows that share an id the least vector asks).
    Fewer than ``k`` candidates give fewer rows; repeated rows are candidates each.  Scores are
    64-bit integers.  ``bits``: 8 at most.  Other columns are not read, whatever their names.
    """
    rows = integer_vectors(vectors, id_column, vector, scale).withColumn("number", F.monotonically_increasing_id())
    rows = stage(rows, "va-vectors")
    cells = ranges(rows, bits)
    file = stage(cell_file(rows, cells).withColumn("block", F.monotonically_increasing_id()), "va-file")
    asked = stage(rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("x").alias("x")), "va-asked")
    queries = stage(query_file(asked).withColumn("query_block", F.monotonically_increasing_id()), "va-queries")
    found = stage(candidates(file, queries, cells, k), "va-candidates")
    near = stage(read_in_order(found, rows, asked, k), "va-read")
    discard(file, queries, found, rows, asked)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")
