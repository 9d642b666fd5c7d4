"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

The reference is the corpus itself.  Every document is cut into blocks: a block is the run
of windows (``window`` words each) that have the same anchor, the anchor being the window's
least hash of ``GRAM`` words.  Equal text is cut alike wherever it stands.  The index is a
shuffle on the anchor: it tells a document, for each of its anchors, the reference block that
holds the same one elsewhere, and that is where a factor begins.

A factor is extended from its anchor, word by word and to both sides, to the longest match
with the reference block.  Where the whole block matches, the parse goes on to the block
behind it, so factors on the same reference join into longer ones (``factors`` gives them:
greedily, the longest at each place, then on from its end).  A factor of ``window`` words or
more is a duplicate span, on both sides.

A block has one reference, so at the boundaries of a factor, where the block goes on without
it, windows may still occur in a third place.  These are looked up by the hash of their words
among all windows that no factor covers.  So the result is exact: a window is found if and
only if its words also start anywhere else.

Nothing is compared pair by pair: a passage that a third of all documents share costs a row
for each of its blocks, each compared with one reference.  Words and ranges of words are
known by 64-bit hashes; an equal window has an equal anchor as well, so 128 bits must agree.
A hot anchor meets its one reference in a join that adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, nested, quoted, small_batches, stage, text_bytes, unnested, without, word_hashes

GRAM = 12
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
PLACE = np.uint64((1 << 31) - 1)
WORD = re.compile(rb"[^ \t-\r]+[ \t-\r]*")


class RangeHash:
    """64-bit hashes of ranges of one text's words, from running sums."""

    def __init__(self):
        self.words, self.powers, self.inverses = word_hashes(seed=9), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def load(self, words: list[bytes]) -> None:
        n = len(words)
        if n >= len(self.powers):
            size = 2 * n + 1024
            steps = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            self.powers, self.inverses = (np.concatenate([np.ones(1, np.uint64), np.cumprod(x)]) for x in steps)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words.of(words) * self.powers[:n], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[first]) * self.inverses[first]
        return (h ^ (h >> np.uint64(32))) * MIX


def blocks(ranges: RangeHash, n: int, window: int) -> tuple[np.ndarray, ...]:
    """(anchor, content, first window, windows, words before the anchor) of the loaded text of ``n`` words."""
    grams = ranges.of(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    wide = window - GRAM + 1  # grams of a window
    least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
    place = (least & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [len(place)]]))
    at = place[first]
    body = ranges.of(first, first + count + window - 1) + (at - first).astype(np.uint64) * np.uint64(BASE)
    return grams[at], body ^ count.astype(np.uint64), first, count, at - first


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64, copy=False))


INDEX = "anchor long, content long, doc long, text_key long, first int, windows short, lead short"
NO_ID = -(1 << 63)


def _named(docs: DataFrame, id_column: str, text: str, kept: list[str]) -> DataFrame:
    """Rows are known by their id and a hash of their text; the columns in ``kept`` stay in a struct."""
    own_id = F.coalesce(F.col(quoted(id_column)).cast("long"), F.lit(NO_ID))
    return docs.select(own_id.alias("doc"), F.xxhash64(quoted(text)).alias("text_key"), text_bytes(text).alias("bytes"), *([nested(kept)] if kept else []))


def reference_index(docs: DataFrame, window: int) -> DataFrame:
    """A row for each block of each document: its anchor, a hash of its content, and where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, names = RangeHash(), ["anchor", "content", "doc", "text_key", "first", "windows", "lead"]
        for batch in batches:
            out = []
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text.split()
                if len(words) >= window:
                    ranges.load(words)
                    anchor, content, first, count, lead = blocks(ranges, len(words), window)
                    out.append((anchor, content, np.full(len(first), doc), np.full(len(first), key), first, count, lead))
            if out:
                columns = [np.concatenate(x) for x in zip(*out)]
                small = [pa.array(x.astype(t)) for x, t in zip(columns[4:], (np.int32, np.int16, np.int16))]
                yield pa.RecordBatch.from_arrays([*map(_longs, columns[:4]), *small], names=names)

    return docs.select("doc", "text_key", "bytes").mapInArrow(run, INDEX)


BLOCK = ["anchor", "content", "first", "windows", "lead", "n", "is_ref"]


def block_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The blocks in ``wanted`` with the hashes of their words (``words``, eight bytes each)."""
    # A repeated row has its text's blocks counted already, in ``n``.
    wanted = wanted.groupBy("doc", "text_key").agg(F.collect_list(F.struct(*BLOCK)).alias("blocks"))
    rows = docs.select("doc", "text_key", "bytes").join(wanted, ["doc", "text_key"]).select("doc", "text_key", "bytes", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes(seed=9)
        for batch in batches:
            docs_of, keys_of, held, words, n = [], [], [], [], 0
            for k in range(batch.num_rows):
                own = batch.column(3)[k].values
                h = hashes.of(batch.column(2)[k].as_py().split()).tobytes()
                first, count = (own.field(c).to_pylist() for c in ("first", "windows"))
                words += [h[8 * f : 8 * (f + c + window - 1)] for f, c in zip(first, count)]
                docs_of.append(np.full(len(own), batch.column(0)[k].as_py()))
                keys_of.append(np.full(len(own), batch.column(1)[k].as_py()))
                held.append(own)
                n += len(own)
                if n > 8192 or k + 1 == batch.num_rows:
                    whole = pa.concat_arrays(held)
                    columns = [_longs(np.concatenate(docs_of)), _longs(np.concatenate(keys_of)), *(whole.field(c) for c in BLOCK), pa.array(words, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "text_key", *BLOCK, "words"])
                    docs_of, keys_of, held, words, n = [], [], [], [], 0

    return rows.mapInArrow(run, "doc long, text_key long, anchor long, content long, first int, windows short, lead short, n long, is_ref boolean, words binary")


def extend(words: np.ndarray, lead: int, other: np.ndarray, other_lead: int) -> tuple[int, int]:
    """The longest match around the common anchor: first and end word of the factor in the block."""
    left = min(lead, other_lead)
    differ = np.flatnonzero(words[lead - left : lead][::-1] != other[other_lead - left : other_lead][::-1])
    begin = lead - (int(differ[0]) if len(differ) else left)
    right = min(len(words) - lead, len(other) - other_lead)
    differ = np.flatnonzero(words[lead : lead + right] != other[other_lead : other_lead + right])
    return begin, lead + (int(differ[0]) if len(differ) else right)


def window_hashes(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """64-bit hashes of the windows that start at these words."""
    h = np.zeros(len(starts), np.uint64)
    for k in range(window):
        h = h * np.uint64(BASE) + words[starts + k]
    return (h ^ (h >> np.uint64(32))) * MIX


SPAN = ["doc", "text_key", "first", "length"]
FACTORS = {"doc": "long", "text_key": "long", "first": "int", "length": "int", "ref_doc": "long", "ref_key": "long", "ref_first": "int"}
WINDOWS = {"anchor": "long", "body": "long", "n": "long"}


def factored(words: DataFrame, window: int) -> DataFrame:
    """Each block against its anchor's reference block: factors of ``window`` words or more (ref_doc is set),
    for both sides, and the windows that they leave open (body is set)."""
    theirs = ("doc", "text_key", "first", "lead", "n", "words")
    reference = words.filter("is_ref").select("anchor", *(F.col(c).alias("ref_" + c) for c in theirs))
    met = words.join(reference, "anchor").select("doc", "text_key", *BLOCK, "words", *("ref_" + c for c in theirs))
    kinds = {"long": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            r = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            begins, ends = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k in np.flatnonzero(~np.array(r["is_ref"], bool)):
                lead, ref_lead = r["lead"][k], r["ref_lead"][k]
                begin, end = extend(np.frombuffer(r["words"][k], np.uint64), lead, np.frombuffer(r["ref_words"][k], np.uint64), ref_lead)
                if end - begin >= window:
                    begins[k], ends[k] = begin, end
                    here = (r["doc"][k], r["text_key"][k], r["first"][k] + begin)
                    there = (r["ref_doc"][k], r["ref_text_key"][k], r["ref_first"][k] + begin + ref_lead - lead)
                    # A block with a copy is found whole, so only single ones need their factors.
                    out += [(*x[:3], end - begin, *y) for x, y, n in ((here, there, r["n"][k]), (there, here, r["ref_n"][k])) if n == 1]
            columns = [pa.array(list(v), kinds[t]) for v, t in zip(zip(*out), FACTORS.values())] if out else [pa.array([], kinds[t]) for t in FACTORS.values()]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(out), kinds[t]) for t in WINDOWS.values())], names=[*FACTORS, *WINDOWS])
            count = np.array(r["windows"], np.int64)
            base = np.cumsum(count + window - 1) - count - window + 1
            row = np.repeat(np.arange(batch.num_rows), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            left = (at < begins[row]) | (at + window > ends[row])
            row, at = row[left], at[left]
            body = window_hashes(np.frombuffer(b"".join(r["words"]), np.uint64), base[row] + at, window)
            own = {c: np.array(r[c], np.int64)[row] for c in ("doc", "text_key", "first", "anchor", "n")}
            columns = [
                _longs(own["doc"]), _longs(own["text_key"]), pa.array((own["first"] + at).astype(np.int32)), pa.array(np.full(len(row), window, np.int32)),
                *(pa.nulls(len(row), kinds[t]) for t in list(FACTORS.values())[4:]), _longs(own["anchor"]), _longs(body), _longs(own["n"]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*FACTORS, *WINDOWS])

    return met.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in (FACTORS | WINDOWS).items()))


def matches(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Blocks that stand whole elsewhere too, factors of the others, windows found again at their boundaries; the staged tables behind them."""
    small_batches(docs.sparkSession)
    index = stage(reference_index(docs, window), "rlz-index")
    shared = index.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    shared = stage(shared.filter("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "rlz-shared")
    found = stage(index.join(shared, "anchor"), "rlz-found")
    discard(index, shared)
    place = F.struct("doc", "text_key", "first", "windows", "lead")
    counted = found.filter("mixed").groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    counted = stage(counted.select("anchor", "content", "n", "at.*", F.xxhash64("anchor", "content").alias("pick")), "rlz-counted")
    # The reference block of an anchor: any will do, so it is the one with the least hash.
    least = counted.groupBy("anchor").agg(F.min("pick").alias("least"))
    wanted = counted.join(least, "anchor").withColumn("is_ref", F.col("pick") == F.col("least"))
    words = stage(block_words(docs, wanted, window), "rlz-words")
    if words.count() > counted.count():  # repeated rows have given theirs again
        words = stage(words.dropDuplicates(["anchor", "content"]), "rlz-words")
    parsed = stage(factored(words, window), "rlz-parsed")
    discard(words)
    block = ["anchor", "content", "doc", "text_key", "first", (F.col("windows") + F.lit(window - 1)).cast("int").alias("length")]
    again = counted.filter("n > 1").select("anchor", "content")
    whole = found.filter("not mixed").select(*block).union(found.filter("mixed").join(again, ["anchor", "content"]).select(*block))
    left = parsed.filter("ref_doc is null")
    once_more = left.groupBy("anchor", "body").agg(F.sum("n").alias("all")).filter("all > 1").select("anchor", "body")
    edges = left.filter("n = 1").join(once_more, ["anchor", "body"]).select(*SPAN)
    return whole, parsed.filter("ref_doc is not null").select(*FACTORS), edges, [found, counted, parsed]


def parse(matched: list[tuple[int, int, tuple]]) -> list[tuple[int, int, tuple]]:
    """The greedy parse of a document: at each place the match (first word, end, (reference, its first word)) that reaches farthest, then on from its end."""
    matched, out, at, k, best = sorted(matched), [], 0, 0, None
    while True:
        while k < len(matched) and matched[k][0] <= at:
            if best is None or matched[k][1] > best[1]:
                best = matched[k]
            k += 1
        if best is not None and best[1] > at:
            first, end, (ref, ref_first) = best
            out.append((at, end - at, (ref, ref_first + at - first)))
            at = end
        elif k < len(matched):
            at = matched[k][0]
        else:
            return out


def factors(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """``(doc, text_key, start, length, ref_doc, ref_start)``: each document's factors, from matches of ``window`` words or more.

    A document is parsed greedily: the match that reaches farthest from where the parse stands
    is a factor, and the parse goes on at its end.  ``ref_doc`` and ``ref_start`` tell where its
    words stand elsewhere.  ``doc`` is the id (the least integer for null), ``text_key`` a hash of the text.
    """
    whole, partial, _, held = matches(_named(docs, id_column, text, []), window)
    # A block that stands whole elsewhere refers to the occurrence with the least place, and that one to the greatest.
    own = F.struct("doc", "text_key", "first")
    ends = whole.groupBy("anchor", "content").agg(F.min(own).alias("low"), F.max(own).alias("high"))
    told = whole.join(ends, ["anchor", "content"]).withColumn("ref", F.when(own == F.col("low"), F.col("high")).otherwise(F.col("low")))
    told = told.select(*SPAN, F.col("ref.doc").alias("ref_doc"), F.col("ref.text_key").alias("ref_key"), F.col("ref.first").alias("ref_first"))
    told = told.union(partial)
    # Matches that go on in the same reference are one.
    same = Window.partitionBy("doc", "text_key", "ref_doc", "ref_key", F.col("ref_first") - F.col("first")).orderBy("first", "length")
    ahead = F.max(F.col("first") + F.col("length")).over(same.rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("new", F.when(F.col("first") <= ahead, 0).otherwise(1)).withColumn("chain", F.sum("new").over(same))
    joined = told.groupBy("doc", "text_key", "ref_doc", "ref_key", (F.col("ref_first") - F.col("first")).alias("shift"), "chain")
    joined = joined.agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("length")).alias("end"))
    by_doc = joined.groupBy("doc", "text_key").agg(F.collect_list(F.struct("first", "end", "ref_doc", "shift")).alias("matched"))  # no more than the text has words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "text_key", "start", "length", "ref_doc", "ref_start"]
        for batch in batches:
            out = []
            for doc, key, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                out += [(doc, key, at, n, *ref) for at, n, ref in parse([(m["first"], m["end"], (m["ref_doc"], m["first"] + m["shift"])) for m in own])]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.int64()) for v in (zip(*out) if out else [[]] * 6)], names=names)

    out = stage(by_doc.mapInArrow(run, "doc long, text_key long, start long, length long, ref_doc long, ref_start long"), "rlz-factors")
    discard(*held)
    return out


def duplicate_spans(docs: DataFrame, window: int) -> DataFrame:
    """``(doc, text_key, spans)``: for each row with repeated passages its runs of covered words (first, length)."""
    whole, partial, edges, held = matches(docs, window)
    spans = whole.select(*SPAN).union(partial.select(*SPAN)).union(edges)
    spans = stage(spans.groupBy("doc", "text_key").agg(F.collect_set(F.struct("first", "length")).alias("spans")), "rlz-spans")
    discard(*held)
    return spans


ADDED = "n_words long, n_removed long, kept_sha256 string, kept_text binary"


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = 35, with_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and (``with_text``) kept_text, a row for each row.

    Removed is each word that a window of ``window`` words covers whose word sequence also
    starts anywhere else, in the same document or another (all occurrences go, the first
    included).  Windows are judged on the input.  Words are split at ASCII white space.
    ``kept_text`` keeps the white space after each kept word; the hash is of the kept words
    joined by single spaces.  Null texts count as empty; repeated rows are copies of each
    other, with null ids as well.  A text is held whole in the task that reads it, with some
    fifty bytes for each word.  Columns of ``docs`` with an added name are replaced.
    """
    added = T._parse_datatype_string(ADDED).fields[: 4 if with_text else 3]
    keep = [c for c in without(docs.columns, ["n_words", "n_removed", "kept_sha256", "kept_text"]) if with_text or c != text]
    spans = duplicate_spans(_named(docs, id_column, text, []), window)
    rows = _named(docs, id_column, text, keep).join(spans, ["doc", "text_key"], "left")
    rows = rows.select(*(["row"] if keep else []), "bytes", "spans")
    schema = T.StructType([*([rows.schema["row"]] if keep else []), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of, removed_of, hashes, texts = [], [], [], []
            for content, own in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist()):
                words = content.split()
                n, gone = len(words), 0
                if own:
                    turns = np.zeros(n + 1, np.int64)
                    np.add.at(turns, [s["first"] for s in own], 1)
                    np.add.at(turns, [s["first"] + s["length"] for s in own], -1)
                    stays = np.cumsum(turns[:n]) == 0
                    gone = n - int(stays.sum())
                    parts = [w for w, s in zip(WORD.findall(content), stays) if s] if with_text else []
                    words = [w for w, s in zip(words, stays) if s]
                    content = b"".join(parts)
                words_of.append(n)
                removed_of.append(gone)
                hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
                texts.append(content)
            new = [pa.array(words_of, pa.int64()), pa.array(removed_of, pa.int64()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new, *([pa.array(texts, pa.binary())] if with_text else [])], names=schema.names)

    out = unnested(rows.mapInArrow(run, schema), keep, [f.name for f in added])
    return out.withColumn("kept_text", F.col("kept_text").cast("string")) if with_text else out
