"""Line-first cleaning: rules on single lines first, then on what is left of the document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import nested, small_batches, text_bytes, unnested, without

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
MARKS = re.compile(rb"[#*$%&<>!]")
SEPARATORS = re.compile("|".join(["[|]", "»", "›", "•", "·", "→"]).encode())
CLOSERS = b"\"')]}*_"
TERMINAL = (b".", b"!", b"?", b":", b";", "…".encode(), "。".encode(), "！".encode(), "？".encode(), "”".encode(), "’".encode(), "»".encode())
BOILERPLATE = re.compile(
    rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept cookies|click here"
    rb"|sign up|log ?in\b|subscribe (?:now|to)|javascript|powered by|lorem ipsum|back to top|skip to content|share (?:this|on)",
    re.IGNORECASE,
)


def failed_rule(line: bytes, words: list[bytes], stub_words: int = 8, mark_share: float = 0.3, boilerplate_words: int = 30) -> str:
    """The first rule that a line with words fails, or ''.

    navigation: at least one separator for every four words.  punctuation: more
    symbol marks than ``mark_share`` a word, or fewer than ``stub_words`` words and no
    terminal mark.  boilerplate: a stock phrase in at most ``boilerplate_words`` words.
    """
    n = len(words)
    if 4 * len(SEPARATORS.findall(line)) >= n:
        return "navigation"
    if len(MARKS.findall(line)) > mark_share * n + 1:
        return "punctuation"
    if n < stub_words:
        end = line.rstrip(SPACES)
        if not (end.endswith(TERMINAL) or end.rstrip(CLOSERS).endswith(TERMINAL)):
            return "punctuation"
    if n <= boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more, the first one included."""
    counts = Counter(zip(words, words[1:], words[2:]))
    if len(counts) == max(0, len(words) - 2):
        return 0
    covered, until = 0, 0
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if counts[window] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


FIELDS = [
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("n_lines", T.LongType()),
    ("n_lines_removed", T.LongType()), ("n_words_removed", T.LongType()),
]


def measure(text: bytes, max_lost: float = 0.5, min_words: int = 50) -> tuple[tuple, bytes]:
    """The figures of one text, in the order of FIELDS, and its cleaned text."""
    words = text.split()
    n = len(words)
    in_words = text.translate(None, SPACES)
    word_chars = len(in_words) - len(in_words.translate(None, NOT_CONTINUATION))
    seen: set[bytes] = set()
    dup_lines = lines = removed = lost = 0
    kept_lines = []
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            lines += 1
            if line in seen:
                dup_lines += 1
            seen.add(line)
            if failed_rule(line, own):
                removed += 1
                lost += len(own)
                continue
        kept_lines.append(line)
    repeats = repeated_words(words)
    base_failed = n < min_words or 100 * repeats > 50 * n
    kept = not base_failed and lost <= max_lost * n
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (n, word_chars, symbols, dup_lines, repeats, base_failed, kept, lines, removed, lost), b"\n".join(kept_lines)


NOT_CONTINUATION = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def clean_lines(docs: DataFrame, text: str = "text", max_lost: float = 0.5, min_words: int = 50) -> DataFrame:
    """``docs`` with a figure for each of FIELDS and ``clean_text``, one row for each row.

    Words are split at ASCII white space.  A null text is taken as an empty one
    (base_failed, as it has under ``min_words`` words).  Columns of ``docs`` with the
    name of a figure are replaced.  Nothing is shuffled: each row is judged alone, with its
    text and words held whole in the task that reads it.
    """
    small_batches(docs.sparkSession)
    names = [name for name, _ in FIELDS]
    keep = without(docs.columns, [*names, "clean_text"])
    source = docs.select(nested(keep), text_bytes(text).alias("bytes"))
    schema = T.StructType([source.schema["row"], *(T.StructField(n, t) for n, t in FIELDS), T.StructField("clean_text", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(t, max_lost, min_words) for t in batch.column("bytes").to_pylist()]
            figures = zip(*(g[0] for g in got)) if got else [[]] * len(names)
            columns = [pa.array(list(v), pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n, v in zip(names, figures)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *columns, pa.array([g[1] for g in got], pa.binary())], names=["row", *names, "clean_text"]
            )

    out = unnested(source.mapInArrow(run, schema), keep, [*names, "clean_text"])
    return out.withColumn("clean_text", F.col("clean_text").cast("string"))
