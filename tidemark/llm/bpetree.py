"""Encoding of long texts in parallel by tree concatenation, and decoding.

A text longer than ``leaf`` characters is halved again and again; its leaves are encoded
by different tasks.  The ids of two neighbours cannot just be joined, as the tokens next
to the cut were made without what stands on the other side.  So a window around the cut
is encoded anew, and grows until its tokens agree with those of both sides: the same
tokens at the same places, ``AGREE`` in a row, to the left and to the right of the cut.
Between these places the window's tokens replace both sides'.  Joins go up the tree, so
a window that reaches past a leaf finds its neighbours joined already; in the end it is
the text itself, so the result is always that of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage
from tidemark.llm.tokens import TextEncoder, encoder_for

AGREE = 3


class Part:
    """Tokens of text[begin:end]: ids and the places (in the text) where each begins and ends."""

    def __init__(self, begin: int, end: int, ids: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.begin, self.end, self.ids, self.first, self.last = begin, end, ids, first, last


def load_tokenizer(path: str):
    """One tokenizer for each Python worker."""
    return encoder_for(path).tokenizer


def encode_part(tokenizer, text: str, begin: int, end: int) -> Part:
    got = tokenizer.encode(text[begin:end], add_special_tokens=False)
    places = np.array(got.offsets, np.int64).reshape(-1, 2) + begin
    return Part(begin, end, np.array(got.ids, "<u4"), places[:, 0], places[:, 1])


def encode_leaf(encoder: TextEncoder, leaf: str) -> Part:
    """As ``encode_part`` of a whole leaf, by what the encoder remembers."""
    return Part(0, len(leaf), *encoder.places(leaf))


def pack_part(part: Part) -> bytes:
    """Ids and places in few bytes: two for the id, one each for a token's length and the gap before it."""
    length = part.last - part.first
    gap = part.first - np.concatenate([[part.begin], part.last[:-1]])
    small = lambda x, low, high: not len(x) or (x.min() >= low and x.max() <= high)
    if small(part.ids, 0, 65535) and small(length, 0, 255) and small(gap, -128, 127):
        return b"\1" + part.ids.astype("<u2").tobytes() + length.astype("u1").tobytes() + gap.astype("i1").tobytes()
    return b"\0" + np.stack([part.ids, part.first - part.begin, part.last - part.begin]).astype("<u4").tobytes()


def unpack_part(packed: bytes, begin: int, end: int) -> Part:
    if packed[0] == 0:
        ids, first, last = np.frombuffer(packed, "<u4", offset=1).reshape(3, -1)
        return Part(begin, end, ids, first.astype(np.int64) + begin, last.astype(np.int64) + begin)
    n = (len(packed) - 1) // 4
    length = np.frombuffer(packed, "u1", n, 1 + 2 * n).astype(np.int64)
    gap = np.frombuffer(packed, "i1", n, 1 + 3 * n).astype(np.int64)
    last = begin + np.cumsum(gap + length)
    return Part(begin, end, np.frombuffer(packed, "<u2", n, 1).astype("<u4"), last - length, last)


def _agreement(a: Part, b: Part, low: int, high: int, from_left: bool) -> tuple[int, int] | None:
    """Numbers of the first (or last) ``AGREE`` tokens in a row that a and b share within [low, high)."""
    where = {}
    for k in np.flatnonzero((b.first >= low) & (b.last <= high)):
        where.setdefault((int(b.first[k]), int(b.last[k]), int(b.ids[k])), int(k))
    own = np.flatnonzero((a.first >= low) & (a.last <= high))
    for i in own if from_left else own[::-1]:
        k = where.get((int(a.first[i]), int(a.last[i]), int(a.ids[i])))
        if k is None:
            continue
        turn = range(AGREE) if from_left else range(0, -AGREE, -1)
        if all(
            0 <= i + t < len(a.ids) and 0 <= k + t < len(b.ids) and a.ids[i + t] == b.ids[k + t] and a.first[i + t] == b.first[k + t] and a.last[i + t] == b.last[k + t]
            for t in turn
        ):
            return int(i), k
    return None


def join(tokenizer, text: str, left: Part, right: Part, reach: int = 48) -> Part:
    """The tokens of text[left.begin:right.end]."""
    cut = left.end
    while True:
        begin, end = max(left.begin, cut - reach), min(right.end, cut + reach)
        middle = encode_part(tokenizer, text, begin, end)
        whole_left, whole_right = begin == left.begin, end == right.end
        # Half of the reach next to the window's own ends is not trusted to be like the whole text's.
        a = (0, 0) if whole_left else _agreement(left, middle, cut - reach + reach // 4, cut - reach // 4, True)
        b = (len(right.ids) - 1, len(middle.ids) - 1) if whole_right else _agreement(right, middle, cut + reach // 4, cut + reach - reach // 4, False)
        if a and b and (whole_left or whole_right or a[1] <= b[1]):
            i, p = a
            j, q = b
            pieces = [
                (left.ids[:i], left.first[:i], left.last[:i]) if not whole_left else None,
                (middle.ids[p : q + 1], middle.first[p : q + 1], middle.last[p : q + 1]),
                (right.ids[j + 1 :], right.first[j + 1 :], right.last[j + 1 :]) if not whole_right else None,
            ]
            ids, first, last = (np.concatenate(x) for x in zip(*(x for x in pieces if x)))
            return Part(left.begin, right.end, ids, first, last)
        reach *= 2


def halves(length: int, leaf: int) -> list[tuple[int, int]]:
    """The leaves of the tree over a text of this length."""
    if length <= leaf:
        return [(0, length)]
    depth = (length - 1) // leaf
    count = 1 << depth.bit_length()
    borders = [length * k // count for k in range(count + 1)]
    return list(zip(borders, borders[1:]))


def concatenate(tokenizer, text: str, parts: list[Part]) -> Part:
    while len(parts) > 1:
        parts = [join(tokenizer, text, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def encode_decode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", leaf: int = 16_384, with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again: one row for each row.

    Columns: the id column, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids),
    decoded_sha256 and, if wanted, ids and decoded.  ``leaf``: characters up to which a text
    is encoded at once.  A null text is an empty one, without ids.  Null ids and repeated
    rows stay as they are.  Other columns are not read.
    """
    path = tokenizer
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    long = F.length("_text") > leaf
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def results(encoder, ids_of: pa.Array, all_ids: list[bytes]) -> pa.RecordBatch:
        decoded = encoder.decode(all_ids)
        columns = [
            ids_of, pa.array([len(x) // 4 for x in all_ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in all_ids], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
        ]
        if with_ids:
            columns += [pa.array([np.frombuffer(x, "<u4") for x in all_ids], pa.list_(pa.int64())), pa.array([str(x, "utf-8") for x in decoded], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield results(encoder, part.column("_id"), [*map(encoder.encode, part.column("_text").cast(pa.binary()).to_pylist())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, content in zip(batch.column("_id"), batch.column("_row").to_pylist(), batch.column("_text").to_pylist()):
                leaves = halves(len(content), leaf)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc.as_py()] * len(leaves), doc.type), pa.array([row] * len(leaves), pa.int64()),
                        pa.array([b for b, _ in leaves], pa.int64()), pa.array([content[b:e] for b, e in leaves], pa.string()),
                    ],
                    names=["_id", "_row", "begin", "leaf"],
                )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            out = []
            for content in batch.column("leaf").to_pylist():
                out.append(pack_part(encode_leaf(encoder, content)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "tokens"])

    def assemble(key, frame):
        import pandas as pd

        encoder = encoder_for(path)
        frame = frame.sort_values("begin")
        content = "".join(frame["leaf"])
        parts = []
        for begin, own, tokens in zip(frame["begin"], frame["leaf"], frame["tokens"]):
            parts.append(unpack_part(tokens, int(begin), int(begin) + len(own)))
        whole = concatenate(encoder.tokenizer, content, parts)
        batch = results(encoder, pa.array([frame["_id"].iloc[0]]), [whole.ids.astype("<u4").tobytes()])
        return pd.DataFrame({n: batch.column(n).to_pylist() for n in names})

    done = rows.filter(~long).mapInArrow(short, schema)
    leaves = rows.filter(long).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(cut, f"_id {id_type}, _row long, begin long, leaf string")
    # Leaves of one text go to different tasks; written once, so that a row's number is fixed.
    dealt = stage(leaves.repartition("_row", "begin").mapInArrow(encode, f"_id {id_type}, _row long, begin long, leaf string, tokens binary"), "bpe-leaves")
    joined = dealt.groupBy("_row").applyInPandas(assemble, schema)
    return done.union(joined).withColumnRenamed("_id", id_column)
