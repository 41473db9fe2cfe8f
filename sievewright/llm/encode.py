"""Whole texts to ids by the tokenizers library, each distinct chunk of text encoded once.

A byte-pair encoder never merges across the pieces its pre-tokenizer cuts, so the ids of a text are
the ids of its pieces one after another. Two pre-tokenizers are known (see KINDS); neither cuts
differently when a text is first split at single spaces (or, where white space is dropped, at any).
So texts are split there, and each chunk is looked up in a bounded table of chunks met before; the
pieces of a new one are cut by the pre-tokenizer's pattern and encoded by the library's model.
Texts with characters outside the safe ones or with a special token's string, and all texts of other
tokenizers, go to the library whole, so the result is always the library's.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

#: White space and non-decimal numbers among the characters below U+0250.
SPACE = "\\t-\\r \\x85\\xa0"
NUMBERS = "²³¹¼½¾"
#: Characters whose class and case are the same in Python and in the library; all are stable under NFC.
UNSAFE = re.compile("[^\\x00-\\u012f\\u0132-\\u024f‐-‧€]")
#: White space for Python's split() only, not for the library.
ODD = "\x1c\x1d\x1e\x1f"
#: Next to other white space a space may belong to another piece; texts with that or FIRST are cut whole.
MIXED_SPACE = ("\0", "  ", "\n ", " \n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")
FIRST = "\0"
LETTER, NUMBER, OTHER = rf"[^\W\d_{NUMBERS}]", rf"[\d{NUMBERS}]", rf"(?:[^\w{SPACE}]|_)"
KINDS = {
    "bytes": re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?{LETTER}+| ?{NUMBER}+| ?{OTHER}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"),
    "words": re.compile(rf"'(?:s|t|re|ve|m|ll|d)|{LETTER}+|{NUMBER}|{OTHER}+"),
}
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def kind_of(spec: dict) -> str | None:
    """Which of KINDS cuts a text as this tokenizer does."""
    if spec["model"]["type"] != "BPE" or spec.get("post_processor") and spec["post_processor"]["type"] != "ByteLevel":
        return None
    norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]:
        return "bytes"
    steps = pre.get("pretokenizers") or [{}]
    split = steps[0]
    if norm and norm.get("normalizers") == WORDS_NORMALIZER and len(steps) == 2 and split.get("type") == "Split" and split["pattern"] == {"Regex": WORDS_PATTERN} and split["invert"] and split["behavior"] == "Removed" and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
        return "words"
    return None


def vocabulary_size(path: str, *more: int) -> int:
    """Ids lie below this: the tokenizer's, and any added ones."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), *(x + 1 for x in more))


_here: dict[tuple, object] = {}


def worker_wide(make, *args):
    """make(*args), once for each Python worker: what it has learned serves the worker's later tasks.

    A worker outlives its stage, so it keeps one such object: the next stage's replaces it.
    """
    key = (make.__qualname__, *args)
    if key not in _here:
        _here.clear()
        release()
        _here[key] = make(*args)
    return _here[key]


def release() -> None:
    """Give memory that is free but still held back to the system: workers outlive their tasks, and an
    executor's other worker and its JVM need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


class Known(dict):
    """Results by piece, `keep` at most. The frequent pieces come early, so a full table takes no more
    and stays as it is, unless a batch has most of its pieces not in it: then it starts anew."""

    def __init__(self, keep: int):
        self.keep = keep

    def lookup(self, pieces: set, ask):
        """A function from each of these pieces to its result; ask(list) gives those of unknown ones."""
        new = list(pieces.difference(self))
        if not new:
            return self.__getitem__
        found = dict(zip(new, ask(new)))
        if len(self) + len(found) <= self.keep:
            self.update(found)
            return self.__getitem__
        anew = 2 * len(new) > len(pieces)
        found.update((p, self[p]) for p in pieces if p in self)
        if anew:
            self.clear()
            if len(found) <= self.keep:
                self.update(found)
        return found.__getitem__


def byte_marks() -> dict[int, str]:
    """Byte-level tokenizers write a byte as a printable character: itself if it is one, else the next
    unused one from U+0100. For each safe character, those of its UTF-8 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in plain]
    mark = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return {c: "".join(mark[b] for b in chr(c).encode()) for c in (*range(0x250), *range(0x2010, 0x2028), 0x20AC)}


class Chunks(dict):
    """Ids of chunks, `keep` at most. The frequent ones come early, so a full table takes no more; it
    starts anew if twice as many as it holds were not found since."""

    def __init__(self, keep: int, ask):
        self.keep, self.ask, self.missed = keep, ask, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.ask(chunk)
        if len(self) < self.keep:
            if len(chunk) <= 40:
                self[chunk] = ids
        else:
            self.missed += 1
            if self.missed > 2 * self.keep:
                self.clear()
                self.missed = 0
        return ids


class Encoder:
    """Texts to little-endian ids."""

    def __init__(self, path: str, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = kind_of(spec)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size(with_added_tokens=True) <= 65536 else np.dtype("<u4")
        self.code = "HI"[self.dtype.itemsize > 2]
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.model, self.marks, self.table = self.tok.model.tokenize, byte_marks(), Chunks(keep, self.chunk)
        self.mark = self.marks[32] if self.kind == "bytes" else ""
        self.stops: dict[str, bytes] = {}
        if self.kind:
            self.stops = {c: self.pieces(c) for c in ".,"}

    def ask(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> bytes:
        """The ids of a text (as the pre-tokenizer gets it) by the pattern and the model."""
        ids = [t.id for p in KINDS[self.kind].findall(text) for t in self.model(p.translate(self.marks))]
        return array(self.code, ids).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """The ids of a chunk. In the table of kind "bytes" a chunk stands without the space before it;
        one that has none, at the start of a text, has FIRST instead.

        A chunk of letters is one piece; so are its letters if one stop or comma follows, which is
        another. They need no pattern, and the letters may be known.
        """
        if chunk.isalpha():
            word = chunk if chunk.isascii() else chunk.translate(self.marks)
            return array(self.code, [t.id for t in self.model(self.mark + word)]).tobytes()
        if chunk[-1:] in self.stops and chunk[:-1].isalpha():
            return self.table[chunk[:-1]] + self.stops[chunk[-1]]
        if self.kind == "words":
            return self.pieces(chunk)
        return self.pieces(chunk[1:] if chunk[:1] == FIRST else " " + chunk)

    def one(self, text: str) -> bytes:
        if not text:
            return b""
        if not text.isascii() and UNSAFE.search(text) or any(x in text for x in self.special):
            return self.ask([text])[0]
        if self.kind == "words":
            if any(c in text for c in ODD):
                return self.ask([text])[0]
            return b"".join(map(self.table.__getitem__, text.lower().split()))
        if text[0] == " " or text[-1] == " " or any(x in text for x in MIXED_SPACE):
            return self.pieces(text)
        return b"".join(map(self.table.__getitem__, (FIRST + text).split(" ")))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of self.dtype."""
        if self.kind is None:
            return [x for i in range(0, len(texts), 256) for x in self.ask(texts[i : i + 256])]
        return [self.one(t) for t in texts]


def slices(texts: list[str | None], chars: int = 2_000_000):
    """Index ranges of at most so many characters (one text at least): bounds what a task holds."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
