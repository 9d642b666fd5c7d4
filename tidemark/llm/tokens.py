"""Whole-text encoding with a public tokenizer file, with a memory of chunks.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the ids
of the chunks, joined, are the ids of the text; chunks come back often, and the
library encodes each of them once for a worker.  Texts for which that cannot be
told from their bytes go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from tidemark.llm.common import remembered

#: Byte-level files keep white space: such texts are cut before a single space between two visible
#: characters.  These need the library: white space next to that space, or white space outside ASCII.
_IRREGULAR = re.compile(rb" [\x00-\x20]| \Z|[\x00-\x1f] |\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80")

#: Without other control characters than the line feed, the same is told by these alone, at a third of the time.
_CONTROLS, _BESIDE_SPACE = bytes(k for k in range(32) if k != 10), (b"  ", b" \n", b"\n ")
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80")


def irregular(text: bytes) -> bool:
    """Whether ``_IRREGULAR`` is found in a text."""
    if len(text.translate(None, _CONTROLS)) != len(text):
        return _IRREGULAR.search(text) is not None
    return text.endswith(b" ") or any([x in text for x in _BESIDE_SPACE]) or (not text.isascii() and any([x in text for x in _WIDE]))


#: A word of Latin letters and its closing marks: two pre-tokens at most, whatever stands around them.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: Lines in a chunk: a line feed between two visible characters is a pre-token of its own.
_LINES = re.compile(rb"[^\x00-\x20\x7f]+(?:\n[^\x00-\x20\x7f]+)+")
#: The mark that word-level files put at the end of a word's last token.
_END = "</w>"
#: Bytes up to which a chunk is remembered.
_LONGEST = 256


def byte_symbols() -> list[str]:
    """The visible character by which byte-level files write each byte."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class _Chunks(dict):
    """Ids of chunks; a full memory keeps what it holds, as frequent chunks come early, and long ones do not come back."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: bytes) -> bytes:
        out = self.encode(chunk)
        if len(self) < self.limit and len(chunk) <= _LONGEST:
            self[chunk] = out
        return out


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers (bytes)."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        state = self.tokenizer.to_str()
        self.keeps_space = '"ByteLevel","add_prefix_space":false,"trim_offsets":true,"use_regex":true' in state.split('"post_processor"')[0]
        self.drops_space = '"end_of_word_suffix":"</w>"' in state and '"behavior":"Removed","invert":true' in state
        self.model, self.symbols = self.tokenizer.model, byte_symbols()
        self.chunks, self.spaced = _Chunks(self._chunk, limit), _Chunks(lambda chunk: self._chunk(chunk, b" "), limit)
        self.words = _Chunks(self._word, limit)
        self.line_feed = self.library("\n")
        self.marks = _Chunks(lambda marks: self.library(marks.decode()), 10_000)
        self.placed = _Chunks(self._placed, limit // 4)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        names = [""] * (max(vocabulary.values()) + 1)
        for name, number in vocabulary.items():
            names[number] = name
        self.packed = [k.to_bytes(4, "little") for k in range(len(names))]
        #: Characters that a token stands for, where its text is ASCII.
        self.lengths = np.array([len(n.removesuffix(_END)) for n in names], np.int64)
        #: Without a decoder the library joins the tokens' names by spaces.
        self.names = pa.array([n.encode() + b" " for n in names], pa.large_binary()) if self.tokenizer.decoder is None else None

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: bytes, before: bytes = b"") -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if plain is None:
            if self.keeps_space and _LINES.fullmatch(chunk):
                first, *rest = chunk.split(b"\n")
                return (self.spaced if before else self.chunks)[first] + b"".join([self.line_feed + self.chunks[line] for line in rest])
            return self.library((before + chunk).decode())
        word, marks = plain.groups()
        if self.drops_space:
            word = word.decode().lower().encode()
        ids = self.words[before + word]
        return ids + self.marks[marks] if marks else ids

    def _word(self, word: bytes) -> bytes:
        """Such a word is one pre-token, so the library's model can be asked for it at once."""
        start = self.symbols[32] if word[0] == 32 else ""
        bare = word[1:] if start else word
        symbols = start + (bare.decode() if bare.isalpha() else "".join([self.symbols[b] for b in bare]))
        return b"".join([self.packed[t.id] for t in self.model.tokenize(symbols)])

    def encode(self, text: bytes) -> bytes:
        if self.drops_space:  # no token holds white space, so texts are cut at all ASCII white space
            return b"".join(map(self.chunks.__getitem__, text.split()))
        if self.keeps_space and not irregular(text):
            first, *rest = text.split(b" ")
            return b"".join([self.chunks[first], *map(self.spaced.__getitem__, rest)]) if first else b"".join(map(self.spaced.__getitem__, rest))
        return self.library(text.decode())

    def _placed(self, chunk: bytes) -> bytes:
        """Where the library's tokens of a chunk begin and end, in characters of the chunk."""
        return np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).offsets, "<u4").tobytes()

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text and the places (in characters) where the tokens begin and end, as the library has them."""
        if not self.drops_space:
            got = self.tokenizer.encode(text, add_special_tokens=False)
            first, last = np.array(got.offsets, np.int64).reshape(-1, 2).T
            return np.array(got.ids, "<u4"), first, last
        chunks = text.encode().split()
        found = [*map(self.chunks.__getitem__, chunks)]
        ids = np.frombuffer(b"".join(found), "<u4")
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        letters = np.frombuffer(text.encode("utf-32-le"), "<u4")
        seen = np.concatenate([[False], (letters != 32) & ((letters < 9) | (letters > 13))])
        begin = np.flatnonzero(seen[1:] & ~seen[:-1])  # of each chunk
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        move = np.repeat(begin - ends[np.cumsum(counts) - counts], counts)
        first, last = ends[:-1] + move, ends[1:] + move
        if not text.isascii():  # normalization may change the length of what is not ASCII
            other = ~np.fromiter(map(bytes.isascii, chunks), bool, len(chunks))
            within = np.frombuffer(b"".join([self.placed[c] for c, o in zip(chunks, other.tolist()) if o]), "<u4").reshape(-1, 2)
            tokens, start = np.repeat(other, counts), np.repeat(begin[other], counts[other])
            first[tokens], last[tokens] = start + within[:, 0], start + within[:, 1]
        return ids, first, last

    def decode(self, all_ids: list[bytes]) -> list[bytes | memoryview]:
        """The library's text of each row of ids, special tokens included, in UTF-8."""
        if self.names is None:
            rows = [np.frombuffer(ids, "<u4").tolist() for ids in all_ids]
            return [self.tokenizer.decode(ids, skip_special_tokens=False).encode() for ids in rows]
        taken = self.names.take(pa.array(np.frombuffer(b"".join(all_ids), "<u4")))
        if not len(taken):
            return [b""] * len(all_ids)
        places, names = map(memoryview, taken.buffers()[1:])
        borders = np.frombuffer(places, np.int64)[np.cumsum([0, *map(len, all_ids)]) // 4].tolist()
        return [names[a : max(a, b - 1)] for a, b in zip(borders, borders[1:])]  # without the last space


def encoder_for(path: str) -> TextEncoder:
    """The encoder of this Python worker, which outlives a task with what it remembers, until another operator's memory takes its place."""
    return remembered(("encoder", path), lambda: TextEncoder(path))
