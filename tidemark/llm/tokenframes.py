"""Token-id files of independent zstandard frames with a trailing seek table.

One frame holds the ids of one document (little-endian unsigned 32-bit).  After the
frames come two skippable frames: the document ids, and the seek table of zstandard's
seekable format, whose entries give the compressed size, the size and a checksum (the
low 32 bits of XXH64 of the content) of every frame.  So a reader finds the table from
the file's end and decompresses only the documents that it is asked for, and any
zstandard tool can still decompress a whole file.

Files are written by the tasks through ``pyarrow.fs``, which takes the URIs of shared
file systems and object stores.  A file's name is new for every attempt of a task, and
a manifest names the files that count, so a task that runs twice leaves one file that
nobody reads, never a mixture.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, stage, text_bytes
from tidemark.llm.tokens import encoder_for

# Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
INDEX_MAGIC = 0x184D2A50
CHECKSUM_FLAG = 0x80
NULL_ID = -(1 << 63)


class FrameWriter:
    """Appends one frame for each document; ``close`` adds the index and the seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.compressor = out, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int] = []

    def add(self, doc_id: int, content: bytes) -> None:
        frame = self.compressor.compress(content)
        self.out.write(frame)
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        index = zlib.compress(np.array(self.ids, "<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        n = len(self.entries)
        table = np.array(self.entries, "<u4").tobytes() + struct.pack("<IBI", n, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class FrameReader:
    """Reads chosen documents of a file; ``source`` has seek, read and size."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the file")
        begin = size - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(begin, 8)) != (SKIPPABLE_MAGIC, 12 * n + 9):
            raise ValueError("the seek table does not fit its frame")
        self.table = np.frombuffer(self._at(begin + 8, 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        head = int(self.offsets[-1])
        magic, length = struct.unpack("<II", self._at(head, 8))
        if magic != INDEX_MAGIC or head + 8 + length != begin:
            raise ValueError("the document index is not where the seek table ends the frames")
        self.ids = np.frombuffer(zlib.decompress(self._at(head + 8, length)), "<i8")
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def read(self, k: int) -> np.ndarray:
        """The ids of the document in frame ``k``; its checksum is compared."""
        packed, length, checksum = (int(x) for x in self.table[k])
        content = self.decompressor.decompress(self._at(int(self.offsets[k]), packed), max_output_size=length)
        if len(content) != length or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(content, "<u4")

    def find(self, doc_id: int) -> list[int]:
        """The frames of a document, by bisection (ids ascend)."""
        lo, hi = np.searchsorted(self.ids, [doc_id, doc_id + 1])
        return [*range(int(lo), int(hi))]


MANIFEST = "file string, first_id long, n_docs long, n_tokens long, bytes long, part long"


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, id_column: str = "doc_id", text: str = "text", end_id: int = 1, level: int = 3) -> DataFrame:
    """Encode every document, append ``end_id`` and write the files in ascending id order.

    Returns the manifest (a row for each file, with ``start``: the ids in the files before
    it), a staged table.  Ids are 64-bit integers; null ids come
    first, as the least integer; a null text is an empty one; repeated rows are written
    as often as they come.  Other columns are not written.  An empty table has no files.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-files")
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("_id"), text_bytes(text).alias("_bytes"))
    rows = rows.repartitionByRange(F.col("_id"), F.xxhash64("_bytes")).sortWithinPartitions("_id", F.xxhash64("_bytes"))
    rows = rows.select("_id", "_bytes", F.spark_partition_id().alias("_part"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, first, tokens, part = encoder_for(tokenizer), None, 0, 0, 0
        for batch in batches:
            for doc_id, text_, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if writer is None:
                    place, folder = fs.FileSystem.from_uri(path)
                    place.create_dir(folder, recursive=True)
                    name = f"tokens-{part:06d}-{uuid.uuid4().hex}.zst"
                    stream = place.open_output_stream(f"{folder}/{name}", compression=None, buffer_size=1 << 20)
                    writer, first = FrameWriter(stream, level), doc_id
                ids = encoder.encode(text_) + end
                writer.add(doc_id, ids)
                tokens += len(ids) // 4
        if writer is not None:
            writer.close()
            size = stream.tell()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{path}/{name}", "first_id": first, "n_docs": len(writer.ids), "n_tokens": tokens, "bytes": size, "part": part}])

    manifest = stage(rows.mapInArrow(run, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    manifest = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return stage(manifest, "token-manifest")


def read_token_files(manifest: DataFrame, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Documents of token files: all, or only those asked for (no other frame is decompressed).

    Columns: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if
    wanted, ids.  Damaged frames raise ValueError.  ``start`` counts within all files.
    """
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                place, name = fs.FileSystem.from_uri(file)
                with place.open_input_file(name) as source:
                    reader = FrameReader(source)
                    lengths = reader.table[:, 1].astype(np.int64) // 4
                    starts = start + np.cumsum(lengths) - lengths
                    frames = range(len(lengths)) if wanted is None else [k for x in wanted for k in reader.find(x)]
                    for lo in range(0, len(frames), 4096):
                        own = list(frames[lo : lo + 4096])
                        content = [reader.read(k) for k in own]
                        columns = [
                            pa.array([None if reader.ids[k] == NULL_ID else int(reader.ids[k]) for k in own], pa.int64()),
                            pa.array(starts[own], pa.int64()), pa.array(lengths[own], pa.int64()),
                            pa.array([zlib.crc32(x.tobytes()) for x in content], pa.int64()),
                        ]
                        if with_ids:
                            columns.append(pa.array([x.tolist() for x in content], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    files = manifest.select("file", "start")
    return spread(files).mapInArrow(run, schema)


def spread(files: DataFrame) -> DataFrame:
    """A file each for the tasks: a manifest is small, so Spark would read it in one."""
    return files.repartition(max(1, files.count()), "file")

