"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens.  Every window of ``window`` tokens
takes from each queue its share of the target mixture; what rounding keeps back is
the queue's deficit, which is paid in later windows.  The deficits have a closed
form: the sources are the leaves of a binary tree, and of the first ``n`` tokens that
reach an inner node, ``floor(n * left weight / weight)`` go left and the rest right.
That gives whole tokens that sum to ``n``, never less for a larger ``n``, and within
one token a level of the exact share.  So a task can tell the deficits at any window
without those before it, and partitions need no order among them.

When a queue runs dry the rest go on with their shares (a new phase).  Every token
lies in exactly one piece, and only the last window can need padding.

The sources without a queue of their own share one, in which a second tree of the same
kind deals.  They weigh what they hold, so they all run dry at its last token and it
needs no phases; each of them has its path in that tree as a column, so the driver holds
nothing for them, however many they are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, nested, quoted, small_batches, stage, text_bytes, unnested, without
from tidemark.llm.tokens import encoder_for


class Schedule:
    """Who fills which token slots.  totals: tokens of each queue; weights: the mixture."""

    def __init__(self, totals: list[int], weights: list[int]):
        self.totals, self.weights = totals, weights
        self.phases: list[tuple] = []  # first slot, tokens taken before it, tree, running sums of those tokens
        taken, start = [0] * len(totals), 0
        while True:
            left = [t - x for t, x in zip(totals, taken)]
            live = [i for i, x in enumerate(left) if x > 0]
            tree = self._tree(live)
            self.phases.append((start, taken, tree, [0, *accumulate(taken)]))
            if not live:
                break
            # The phase ends at the first slot count at which some queue is empty.
            n = min(self._slots_until(tree, i, left[i]) for i in live)
            counts = dict.fromkeys(live, 0)
            self._deal(tree, n, counts)
            taken = [x + counts.get(i, 0) for i, x in enumerate(taken)]
            start += n
        self.starts = [p[0] for p in self.phases]
        self.total = start

    def _tree(self, live: list[int]):
        """(weight, first queue, left, right); a leaf has no branches."""
        if not live:
            return None
        if len(live) == 1:
            return (self.weights[live[0]], live[0], None, None)
        half = len(live) // 2
        a, b = self._tree(live[:half]), self._tree(live[half:])
        return (a[0] + b[0], a[1], a, b)

    def _deal(self, tree, n: int, counts: dict[int, int]) -> None:
        while tree[2] is not None:
            left = n * tree[2][0] // tree[0]
            self._deal(tree[2], left, counts)
            tree, n = tree[3], n - left
        counts[tree[1]] = n

    def _slots_until(self, tree, queue: int, tokens: int) -> int:
        """The least number of slots that give the queue so many tokens."""
        path = []
        while tree[2] is not None:
            right = queue >= tree[3][1]
            path.append((right, tree[2][0], tree[0]))
            tree = tree[3] if right else tree[2]
        return _least(path, tokens)

    def before(self, queue: int, slot: int, path: Sequence[int] = ()) -> tuple[int, int]:
        """Tokens of the queue, and of the queues in front of it, in the slots below ``slot``.

        With a ``path``: of the source that has this path in the queue, and of all in front of it.
        """
        start, taken, tree, fronts = self.phases[min(bisect_right(self.starts, slot), len(self.phases)) - 1]
        own, front, n = taken[queue], fronts[queue], slot - start
        while tree is not None:
            if tree[2] is None:
                if tree[1] == queue:
                    own += n
                elif tree[1] < queue:
                    front += n
                break
            left = n * tree[2][0] // tree[0]
            if queue >= tree[3][1]:
                front += left
                tree, n = tree[3], n - left
            else:
                tree, n = tree[2], left
        whole = self.totals[queue]
        for turn in path:
            left = own * abs(turn) // whole
            if turn < 0:
                front, own, whole = front + left, own - left, whole + turn
            else:
                own, whole = left, turn
        return own, front

    def slot_of(self, queue: int, token: int, path: Sequence[int] = ()) -> int:
        """The slot that holds the token of this number of the queue, or of the source with this path in it."""
        steps, whole = [], self.totals[queue]
        for turn in path:
            steps.append((turn < 0, abs(turn), whole))
            whole = whole + turn if turn < 0 else turn
        token = _least(steps, token + 1) - 1
        k = max(i for i, p in enumerate(self.phases) if p[1][queue] <= token)
        start, taken, tree, _ = self.phases[k]
        return start + self._slots_until(tree, queue, token - taken[queue] + 1) - 1


def _least(steps: list[tuple[bool, int, int]], tokens: int) -> int:
    """The least number at the root that gives so many tokens to the node at the end of ``steps`` (right, left weight, weight)."""
    n = tokens
    for right, a, whole in reversed(steps):
        if right:  # least m with m - floor(m a / w) >= n
            m = (n - 1) * whole // (whole - a) + 1
            while m - 1 >= n and (m - 1) - (m - 1) * a // whole >= n:
                m -= 1
            while m - m * a // whole < n:
                m += 1
            n = m
        else:  # least m with floor(m a / w) >= n
            n = -(-n * whole // a)
    return n


def pieces_of(
    schedule: Schedule, queue: int, first: int, length: int, window: int, path: Sequence[int] = ()
) -> Iterator[tuple[int, int, int, int]]:
    """(start in the document, length, window, offset) for tokens [first, first + length) of a queue or of a source in it."""
    at, end = first, first + length
    w = schedule.slot_of(queue, at, path) // window
    own, front = schedule.before(queue, w * window, path)
    while at < end:
        own_next, front_next = schedule.before(queue, min((w + 1) * window, schedule.total), path)
        if own_next > at:
            n = min(end, own_next) - at
            yield at - first, n, w, (front_next - front) + (at - own)
            at += n
            w, own, front = w + 1, own_next, front_next
        else:  # none in this window: on to the one that has the next token
            w = schedule.slot_of(queue, at, path) // window
            own, front = schedule.before(queue, w * window, path)


TREE_BLOCK = 2048  # sources whose part of the tree one task draws


def paths_of(sources: DataFrame, count: int) -> DataFrame:
    """``(_queue, _path)`` for each of the ``count`` rows of ``sources`` (_queue, n): its turns from the root of a tree over all.

    A turn is the weight on the left, negative where the path goes right; weights are sums of ``n``.
    Blocks of sources have a tree each, and the blocks are the leaves of a tree of their own.
    """
    blocks = -(-count // TREE_BLOCK)

    def draw(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["_queue"].to_pylist(), table["n"].to_pylist()))
        sums, paths = [0, *accumulate(n for _, n in rows)], [[] for _ in rows]
        open_nodes = [(0, len(rows))]
        while open_nodes:
            first, end = open_nodes.pop()
            if end - first > 1:
                half = (first + end) // 2
                left = sums[half] - sums[first]
                for i in range(first, end):
                    paths[i].append(left if i < half else -left)
                open_nodes += [(first, half), (half, end)]
        columns = [table["_block"], pa.array([q for q, _ in rows], pa.string()), pa.array(paths, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, names=["_block", "_queue", "_path"])

    dealt = sources.select("_queue", "n", F.pmod(F.xxhash64("_queue"), F.lit(blocks)).cast("string").alias("_block"))
    paths = dealt.groupBy("_block").applyInArrow(draw, "_block string, _queue string, _path array<long>")
    if blocks == 1:
        return paths.select("_queue", "_path")
    # A hash may leave blocks without a source, so they are counted.
    above = stage(dealt.groupBy(F.col("_block").alias("_queue")).agg(F.sum("n").alias("n")), "packing-blocks")
    above = paths_of(above, above.count()).toDF("_block", "_above")
    return paths.join(above, "_block").select("_queue", F.concat("_above", "_path").alias("_path"))


TOKEN_FIELDS = "_part int, _queue string, _first long, _n long, _ids binary"


def encode_queues(docs: DataFrame, tokenizer: str, source: Column, end_id: int, text: str) -> DataFrame:
    """Ids of each document and, for its partition, the tokens of its queue in front of it."""
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(nested(kept), F.spark_partition_id().alias("_part"), source.alias("_queue"), text_bytes(text).alias("_bytes"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(TOKEN_FIELDS).fields])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, reached = encoder_for(tokenizer), {}
        for batch in batches:
            ids = [encoder.encode(t) + end for t in batch.column("_bytes").to_pylist()]
            firsts = []
            for queue, x in zip(batch.column("_queue").to_pylist(), ids):
                firsts.append(reached.get(queue, 0))
                reached[queue] = firsts[-1] + len(x) // 4
            # 16 bits hold every id of most files; a leading byte tells the width.
            packed = [b"\2" + a.astype("<u2").tobytes() if a.max() < 65536 else b"\4" + x for x, a in zip(ids, (np.frombuffer(x, "<u4") for x in ids))]
            new = [pa.array(firsts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=schema.names)

    return rows.mapInArrow(run, schema)


def unpack(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[0] == 2 else "<u4", offset=1).astype("<u4")


PIECE_FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer: str, mixture: dict[str, int] | None = None, source: str = "source", text: str = "text",
    window: int = 2048, end_id: int = 1, max_queues: int = 256, with_ids: bool = False, rest: int = 1,
) -> DataFrame:
    """All documents as pieces of windows of ``window`` tokens; the other columns of ``docs`` stay.

    ``mixture``: integer weights by source (some thousands of them at most, as the driver
    holds them); all sources that it does not name weigh ``rest`` together, in the same unit,
    and share that by what they hold.  A mixture of None keeps the corpus's own proportions
    in every window.  The ``max_queues`` largest sources and all that ``mixture`` names have
    queues of their own; the others share one and are served in it by what they hold, so
    ``max_queues`` bounds what the driver holds and changes no source's share.  A source whose
    share of a window is under a token comes in pieces of single tokens.  A null source is a
    source; a null text is an empty one and holds only ``end_id``; null ids stay.  Repeated
    rows are packed as often as they come.  A text is held whole, with its ids, in the task
    that reads it.  An empty table gives no pieces.  Columns of ``docs`` with the name of an
    added one are replaced.  ``with_ids`` adds the ids of each piece.
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = [f.name for f in T._parse_datatype_string(PIECE_FIELDS).fields] + ["ids"]
    docs = docs.select(*map(quoted, without(docs.columns, added)))
    own = F.concat(F.lit("s"), F.col(quoted(source)).cast("string")) if source in docs.columns else F.lit("s")
    tokens = stage(encode_queues(docs, tokenizer, F.coalesce(own, F.lit("-")), end_id, text), "packing-tokens")
    sums = stage(tokens.groupBy("_part", "_queue").agg(F.sum("_n").alias("n")), "packing-sums")
    sources = sums.groupBy("_queue").agg(F.sum("n").alias("n"))
    named = {f"s{k}": int(w) for k, w in (mixture or {}).items()}
    own_queues = sources.orderBy(F.desc("n"), "_queue").limit(max_queues).collect()
    if named:
        own_queues += sources.filter(F.col("_queue").isin(list(named))).collect()
    total, count = sources.agg(F.sum("n"), F.count("*")).first()
    queues = {q: (i, n) for i, (q, n) in enumerate(sorted({r._queue: r.n for r in own_queues}.items()))}
    totals = [n for _, n in queues.values()] + [(total or 0) - sum(n for _, n in queues.values())]
    # One unit for all: a weight of 1 is as much as the unnamed sources hold, over ``rest``.
    unnamed = totals[-1] + sum(n for q, (_, n) in queues.items() if q not in named)
    weights = [named[q] * max(1, unnamed) if q in named else n * (rest if named else 1) for q, (_, n) in queues.items()]
    weights.append(totals[-1] * (rest if named else 1))
    schedule = Schedule(totals, [max(1, w) for w in weights])
    numbers = F.broadcast(spark.createDataFrame([(q, i) for q, (i, _) in queues.items()], "_queue string, _q int"))  # max_queues rows and those named at most
    # Where each partition's part of a source begins: sums before it.
    to_here = Window.partitionBy("_queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_part", "_queue", F.coalesce(F.sum("n").over(to_here), F.lit(0)).alias("_base"))
    bases = bases.join(numbers, "_queue", "left").withColumn("_q", F.coalesce("_q", F.lit(len(queues))))
    if count > len(queues):
        bases = bases.join(paths_of(sources.join(numbers, "_queue", "left_anti"), count - len(queues)), "_queue", "left")
    else:
        bases = bases.withColumn("_path", F.lit(None).cast("array<long>"))
    bases = stage(bases.select("_part", "_queue", "_q", "_path", "_base"), "packing-bases")
    rows = tokens.join(bases, ["_part", "_queue"])
    kept = [c for c in docs.columns if c != text]
    rows = rows.select("row", "_q", "_path", (F.col("_base") + F.col("_first")).alias("_at"), "_n", "_ids")
    fields = T._parse_datatype_string(PIECE_FIELDS + (", ids array<long>" if with_ids else "")).fields
    schema = T.StructType([rows.schema["row"], *fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, of, ids_out = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("_q", "_path", "_at", "_n", "_ids"))
            for k, (q, path, at, n, packed) in enumerate(zip(*columns)):
                ids = unpack(packed)
                for start, length, sequence, offset in pieces_of(schedule, q, at, n, window, path or ()):
                    piece = ids[start : start + length]
                    out.append((start, length, zlib.crc32(piece.tobytes()), n, sequence, offset))
                    of.append(k)
                    if with_ids:
                        ids_out.append(piece.tolist())
            held = batch.select(["row"]).take(pa.array(of, pa.int64())).columns
            new = [pa.array(list(v), pa.int64()) for v in zip(*out)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([*held, *new, *([pa.array(ids_out, pa.list_(pa.int64()))] if with_ids else [])], names=schema.names)

    discard(sums)
    return unnested(rows.mapInArrow(cut, schema), kept, [f.name for f in fields])
