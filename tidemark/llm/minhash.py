"""Near duplicates by an inverted join on signature coordinates.

A document's signature has ``K`` MinHash coordinates.  Documents are posted under
(coordinate, value) pairs; two documents whose word shingles have a similarity of 0.8
agree in fewer than ``T`` of ``K`` coordinates with a chance below one in a million.

Prefix: to agree in T coordinates a pair must meet in the K - T + 1 pairs that come
first in any order that holds for all documents, so only those are posted.  The order is
by frequency (rarest first), counted exactly over all documents.  A pair that only one
document holds takes its place in the prefix but is posted nowhere, so most documents are
not posted at all, and none is posted under a common passage unless it holds little else.

Merging: in a posting list, each document's collisions are counted over the lists of its
coordinates.  The T - 1 longest of these are skipped: whoever agrees in T coordinates is
found in one of the others, so only those are merged, and the long ones are looked up for
the few documents found.

Collisions above the threshold are candidates unless a second, cheap sketch (one
permutation in ``BINS`` bins) refutes them; a pair at 0.8 is refuted with a chance below
one in a million.  A list yields candidates that connect its documents, not all pairs.
Full shingle sets confirm each candidate.  Where a refuted one was all that held two parts
of a component together, other pairs of these parts could still be linked: such parts meet
again in blocks, where every colliding pair between them is compared.  So every link rests
on full sets, and no link between different texts is lost.

Documents with the same shingle set are one node throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordHash, connected_components, discard, quoted, small_batches, stage, text_bytes, word_hashes

K, T = 24, 9  # coordinates; the least number that must agree
BINS = 128  # of the sketch, a byte each
LEEWAY = 2.3  # how far below the expected number of agreeing bins a pair may lie, times the root of the bins
POSTING_BLOCK = 1024  # documents of a long posting list that meet in one task
SET_BLOCK, SET_SHINGLES = 64, 1 << 20  # documents, and their shingles, that meet in one task when parts of a component do
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BIN_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)


def shingle_set(text: bytes, hashes: WordHash, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z count as a-z."""
    own = text.lower().split()
    if not own:
        return np.empty(0, np.uint64)
    if len(own) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), 1)], np.uint64)
    h = hashes.of(own)
    n = len(h) - words + 1
    out = h[:n].copy()
    for k in range(1, words):
        out = out * M1 + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * M2
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(K, 0xFFFFFFFF, np.uint64)
    for lo in range(0, len(shingles), 8192):
        part = shingles[lo : lo + 8192]
        out = np.minimum(out, ((part[:, None] * MULTIPLIERS) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin, as a byte (0: the bin is empty).  Sorted hashes lie bin by bin."""
    at = np.searchsorted(shingles, BIN_STARTS)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    full = at < np.concatenate([at[1:], [len(shingles)]])
    return np.where(full, least % np.uint64(255) + np.uint64(1), 0).astype(np.uint8)


def unrefuted(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which sketches may belong to sets with a similarity of 0.8 or more with that of ``one`` (rows, or one for all)."""
    either = (one | others) != 0
    bins = either.sum(axis=-1)
    agree = ((one == others) & either).sum(axis=-1)
    return agree >= 0.8 * bins - LEEWAY * np.sqrt(bins)


def _mix(a: np.ndarray, b) -> np.ndarray:
    out = (a ^ (np.asarray(b).astype(np.uint64) * M2)) * M1
    return out ^ (out >> np.uint64(29))


def runs_of(batches: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
    """Calls ``work(keys, table)`` with whole runs of equal keys (first column, sorted)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held and keys[0] == keys[-1] == held[-1].column(0)[-1].as_py():
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        keys = table.column(0).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield from work(keys[:cut], table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield from work(table.column(0).to_numpy(), table)


def forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray], component: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect what ``linked(i, others)`` connects; pairs already connected are skipped.

    ``component``: parts that are connected before.
    """
    component, edges = np.arange(n) if component is None else component.copy(), []
    for i in range(n - 1):
        others = np.flatnonzero(component[i + 1 :] != component[i]) + i + 1
        if not len(others):
            continue
        hits = others[linked(i, others)]
        if len(hits):
            joined, first = np.unique(component[hits], return_index=True)
            edges += [(i, int(hits[k])) for k in first]
            component[np.isin(component, joined)] = component[i]
    return edges


class Merger:
    """Counts collisions in a posting list: one list of documents for each coordinate and value in it."""

    def __init__(self, sig: np.ndarray):
        n = len(sig)
        self.sig, self.order = sig, np.argsort(sig, axis=0, kind="stable").T.copy()
        value = np.take_along_axis(sig.T, self.order, 1)
        new = np.concatenate([np.ones((K, 1), bool), value[:, 1:] != value[:, :-1]], axis=1)
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0), axis=1)
        last = np.minimum.accumulate(np.where(np.concatenate([new[:, 1:], np.ones((K, 1), bool)], axis=1), np.arange(1, n + 1), n)[:, ::-1], axis=1)[:, ::-1]
        self.first, self.last = np.empty((n, K), np.int64), np.empty((n, K), np.int64)
        np.put_along_axis(self.first, self.order.T, first.T, 0)
        np.put_along_axis(self.last, self.order.T, last.T, 0)

    def collisions(self, i: int) -> np.ndarray:
        """The documents behind ``i`` that agree with it in T coordinates or more."""
        length = self.last[i] - self.first[i]
        rank = np.argsort(length, kind="stable")
        merged, skipped = rank[: K - T + 1], rank[K - T + 1 :]
        parts = [self.order[c, self.first[i, c] : self.last[i, c]] for c in merged if length[c] > 1]
        if not parts:
            return np.empty(0, np.int64)
        counts = np.bincount(np.concatenate(parts), minlength=len(self.sig))
        found = np.flatnonzero(counts[i + 1 :]) + i + 1
        total = counts[found] + (self.sig[found[:, None], skipped] == self.sig[i, skipped]).sum(axis=1)
        return found[total >= T]


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def signatures(docs: DataFrame, id_column: str, text: str, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature and sketch (null without words or id)."""
    rows = docs.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), text_bytes(text).alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = shingle_set(content, hashes, words)
                sizes.append(len(own))
                linkable = len(own) and doc_id is not None
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if linkable else None)
                sigs.append(signature(own).tobytes() + sketch(own).tobytes() if linkable else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "sig"],
            )

    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and sketches."""
    whole = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 4 * K + BINS)
    return np.ascontiguousarray(whole[:, : 4 * K]).view(np.uint32), whole[:, 4 * K :]


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(node, keys): for each node that could collide in T coordinates, its keys that other nodes hold too, with their counts."""

    def every_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _unpacked(batch.column(1))[0].astype(np.uint64) | (np.arange(K, dtype=np.uint64) << np.uint64(32))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), K)), pa.array(keys.ravel().astype(np.int64))], names=["node", "key"])

    keys = nodes.select("node", "sig").mapInArrow(every_key, "node long, key long")
    counts = stage(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "minhash-counts")
    own = keys.join(counts.hint("merge"), "key").groupBy("node").agg(F.collect_list(F.struct("n", "key")).alias("keys"))  # K at most
    return own.filter(F.size("keys") >= T)


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect all pairs of nodes with T agreeing coordinates that no sketch refutes."""
    shared = stage(shared_keys(nodes), "minhash-shared")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows, buckets = [], []
                for k, (node, own) in enumerate(zip(part.column("node").to_pylist(), part.column("keys").to_pylist())):
                    # The K - len(own) keys of no one else come first in the order; the rest of the prefix is posted.
                    own = sorted((x["n"], x["key"] * int(M1) & 0xFFFFFFFF, x["key"]) for x in own)[: len(own) - T + 1]
                    for n, _, key in own:
                        blocks = -(-n // POSTING_BLOCK) if n > 2 * POSTING_BLOCK else 1
                        mine = xxhash.xxh3_64_intdigest(node.to_bytes(8, "little"), 3) % blocks
                        # A long list is dealt into blocks; each pair of blocks meets under a key of its own.
                        for other in range(blocks):
                            rows.append(k)
                            buckets.append(xxhash.xxh3_64_intdigest(f"{key} {min(mine, other)} {max(mine, other)}") - (1 << 63))
                        if len(rows) > 8192:
                            yield posted(part, rows, buckets)
                            rows, buckets = [], []
                yield posted(part, rows, buckets)

    def posted(part: pa.RecordBatch, rows: list[int], buckets: list[int]) -> pa.RecordBatch:
        held = part.select(["node", "sig"]).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), *held.columns], names=["bucket", "node", "sig"])

    postings = shared.join(nodes.select("node", "sig").hint("merge"), "node").select("node", "keys", "sig").mapInArrow(post, "bucket long, node long, sig binary")

    def collide(keys: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        length = np.diff(np.concatenate([starts, [len(keys)]]))
        rows = np.repeat(length > 1, length)
        if not rows.any():
            return
        table = table.filter(pa.array(rows))
        ids = table.column("node").to_numpy()
        sig, sketches = _unpacked(table.column("sig"))
        length = length[length > 1]
        starts = np.cumsum(length) - length
        end = np.repeat(starts + length, length)
        a, b = [], []
        at = np.flatnonzero(np.repeat(length <= 6, length))
        for lag in range(1, 6):  # many short lists at once: merging them is comparing them
            at = at[at + lag < end[at]]
            if not len(at):
                break
            hit = at[(sig[at] == sig[at + lag]).sum(axis=1) >= T]
            hit = hit[unrefuted(sketches[hit], sketches[hit + lag])]
            a += ids[hit].tolist()
            b += ids[hit + lag].tolist()
        for s, n in zip(starts[length > 6], length[length > 6]):
            merger, own = Merger(sig[s : s + n]), sketches[s : s + n]

            def linked(i: int, others: np.ndarray) -> np.ndarray:
                hits = np.isin(others, merger.collisions(i))  # noqa: B023
                hits[hits] = unrefuted(own[i], own[others[hits]])  # noqa: B023
                return hits

            for i, j in forest(int(n), linked):
                a.append(int(ids[s + i]))
                b.append(int(ids[s + j]))
        if a:
            yield _pairs(a, b)

    met = postings.repartition("bucket").sortWithinPartitions("bucket")
    found = met.mapInArrow(lambda batches: runs_of(batches, collide), "a long, b long").filter("a != b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_column: str, text: str, words: int) -> DataFrame:
    """(node, shingles) of the given nodes (node, rep, digest): the set is made again from the text of the row that the node stands for."""
    rows = docs.select(F.col(quoted(id_column)).cast("long").alias("rep"), text_bytes(text).alias("bytes"))
    rows = rows.join(nodes, "rep").select("node", "digest", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            found, sets = [], []
            for node, digest, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = shingle_set(content, hashes, words).tobytes()
                if xxhash.xxh3_128_digest(own) == digest:  # not so for another text with the same id
                    found.append(node)
                    sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows.mapInArrow(run, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """``pairs`` (a, b) with ``linked``, told from the full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge")
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= share * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def linked_across(pairs: DataFrame, named: DataFrame, nodes: DataFrame, sets: DataFrame, share: int) -> DataFrame | None:
    """More links, between parts of a component that only refuted candidates hold together; None if there are none such."""
    refuted = pairs.filter("not linked").select("a", "b")
    part = lambda end, name: named.select(F.col("node").alias(end), F.col("component").alias(name)).hint("merge")
    open_pairs = refuted.join(part("a", "x"), "a", "left").join(part("b", "y"), "b", "left")
    open_pairs = stage(open_pairs.filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a"), "minhash-open")
    if open_pairs.isEmpty():
        return None
    loose = connected_components(pairs.select("a", "b"), "minhash-loose")
    groups = open_pairs.select(F.col("a").alias("node")).join(loose, "node").select("component").distinct()
    members = loose.join(groups.hint("merge"), "component").select("node", F.col("component").alias("loose"))
    members = members.join(named.hint("merge"), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    members = stage(members.join(nodes.select("node", "n_shingles", "sig"), "node"), "minhash-members")
    sizes = members.groupBy("loose").agg(F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum("n_shingles") / SET_SHINGLES)).alias("blocks"))
    rows = members.join(sizes.hint("merge"), "loose").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("group", F.xxhash64("loose", F.least("mine", "other"), F.greatest("mine", "other")))
    rows = rows.join(sets, "node").select("group", "node", "part", "sig", "shingles")

    def compare(keys: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, parts = table.column("node").to_numpy(), table.column("part").to_numpy()
        sig, sketches = _unpacked(table.column("sig"))
        sets_ = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        a, b = [], []
        for s, e in zip(starts, [*starts[1:], len(keys)]):
            own = sets_[s:e]

            def linked(i: int, others: np.ndarray) -> np.ndarray:
                hits = (sig[s + others] == sig[s + i]).sum(axis=1) >= T  # noqa: B023
                hits[hits] = unrefuted(sketches[s + i], sketches[s + others[hits]])  # noqa: B023
                for k in np.flatnonzero(hits):
                    x, y = own[i], own[others[k]]  # noqa: B023
                    both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= share * max(len(x), len(y)) else 0
                    hits[k] = 100 * both >= share * (len(x) + len(y) - both)
                return hits

            for i, j in forest(e - s, linked, np.unique(parts[s:e], return_inverse=True)[1]):
                a.append(int(ids[s + i]))
                b.append(int(ids[s + j]))
        if a:
            yield _pairs(a, b)

    met = rows.repartition("group").sortWithinPartitions("group")
    return stage(met.mapInArrow(lambda batches: runs_of(batches, compare), "a long, b long").filter("a != b"), "minhash-across")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, share: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * common shingles >= ``share`` * all shingles of the two
    (``share`` at least 80, for which T is set); ``component_id`` is the smallest id that
    can be reached.  A text with fewer than ``words`` words is one shingle; one without words
    (or null) is linked with nothing, and so is a row with a null id, which stays with a null
    component_id.  Rows that share an id are judged each by its own text.  A text is held whole,
    with eight bytes for each word, in the task that reads it.  Other columns are not read,
    whatever their names.
    """
    if share < 80:
        raise ValueError("the match threshold holds for a share of 80 or more")
    small_batches(docs.sparkSession)
    table = stage(signatures(docs, id_column, text, words), "minhash-signatures")
    nodes = table.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    pairs = stage(candidates(nodes), "minhash-candidates")
    ends = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "minhash-ends")
    sets = stage(shingle_sets(docs, ends.join(nodes.select("node", "rep", "digest").hint("merge"), "node"), id_column, text, words), "minhash-sets")
    if sets.count() > ends.count():  # repeated rows have made theirs again
        sets = stage(sets.dropDuplicates(["node"]), "minhash-sets")
    told = stage(confirmed(pairs, sets, share), "minhash-confirmed")
    links = told.filter("linked").select("a", "b")
    named = connected_components(links, "minhash-components")
    more = linked_across(told, named, nodes, sets, share)
    if more is not None and not more.isEmpty():
        named = connected_components(links.union(more), "minhash-components")
    least = named.join(nodes.select("node", "rep").hint("merge"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    ids = named.join(least.hint("merge"), "component").select("node", "least")
    ids = nodes.select("digest", "node", "rep").join(ids.hint("merge"), "node", "left").select("digest", F.coalesce("least", "rep").alias("named"))
    ids = stage(ids, "minhash-named")
    discard(pairs, ends, sets, told, nodes, *([more] if more is not None else []))
    out = table.join(ids.hint("merge"), "digest", "left").select("doc_id", "n_shingles", F.coalesce("named", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
