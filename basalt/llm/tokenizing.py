"""Encoding whole texts with a `tokenizers` file, each distinct chunk once.

A chunk begins at a space or line feed and ends before the next.  Where the character before one of
these isn't white space itself, no match of the two supported pre-tokenizers crosses that place, so
a text's ids are its chunks' ids in a row; two line feeds before a word are two matches as well.  Only
chunks that the worker hasn't met lately are encoded.  Texts with other runs of white space are encoded as
they are.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from operator import attrgetter

import numpy as np

#: White space of Unicode, before which a text isn't cut at a space.
_WHITE = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_RUNS = ("  ", " \n", "\n ", "\n\n\n")
_RARE = [c for c in _WHITE if c not in " \n"]
_RARE_ASCII = [c for c in _RARE if c.isascii()]
_CACHE_ENTRIES = 450_000  # of a dictionary of chunks, of which a worker has two: some 180 MB
_SLICE = 1 << 14  # chunks that are looked up between two looks at the dictionary's size
_ID = attrgetter("id")
#: A piece that is a match of the pre-tokenizer on its own, whatever stands around it in a chunk.
_PIECE = re.compile(r"[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+|[!-&(-/:-@\[-`{}~]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"  # those of _PIECE


def load(path: str):
    """The tokenizer in a file; strings of special tokens count as ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return dict(zip([*plain, *sorted({*range(256)} - {*plain})], map(chr, [*plain, *range(0x100, 0x144)]), strict=True))


class Recent:
    """A dictionary of bounded size that forgets what wasn't used for long."""

    def __init__(self, most: int = _CACHE_ENTRIES):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        if (value := self.new.get(key)) is None and (value := self.old.get(key)) is not None:
            self.new[key] = value
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Found(dict):
    """ids of chunks; what isn't there is taken from an older dictionary or else found, once, and stays."""

    def __init__(self, find: Callable[[str], bytes], old: dict[str, bytes]):
        super().__init__()
        self.find, self.old = find, old

    def __missing__(self, chunk: str) -> bytes:
        if (raw := self.old.get(chunk)) is None:
            raw = self.find(chunk)
        self[chunk] = raw
        return raw


def splittable(text: str) -> bool:
    """Whether white space stands alone, but for two line feeds."""
    if any(x in text for x in _RUNS) or text[-1:] == "\n":
        return False
    return not any(c in text and (c + " " in text or c + "\n" in text or "\n\n" + c in text) for c in (_RARE_ASCII if text.isascii() else _RARE))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def chunks_of(text: str) -> list[str]:
    """Chunks without their first space, or with their first line feed; the first has neither, or a line feed."""
    return text.replace("\n", " \n").split(" ")


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder; what it has learned serves the worker's later tasks."""
    return ChunkEncoder(path)


class ChunkEncoder:
    """encode(texts): the ids of all texts in a row, and where each text's ids begin."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        with open(path) as f:
            self.lower = "Lowercase" in json.dumps(json.load(f).get("normalizer"))
        self.most = _CACHE_ENTRIES
        self.chunks, self.pieces = Found(self._find, {}), Recent(_CACHE_ENTRIES // 6)
        self.seen, self.copies = Recent(50_000), Recent(500)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tokens(self, seen: str) -> bytes:
        """The ids of a piece in the vocabulary's letters."""
        return array("I", map(_ID, self.tokenize(seen))).tobytes()

    def _piece(self, piece: str) -> bytes:
        if (raw := self.pieces.get(piece)) is None:
            raw = self._tokens(piece.encode().decode("latin-1").translate(self.letters))
            self.pieces.put(piece, raw)
        return raw

    def _chunk(self, chunk: str) -> bytes | None:
        """The ids of a chunk that is made of plain pieces, else None."""
        line = chunk[:1] == "\n"
        words = chunk[line:]
        bare = words.rstrip(_MARKS)
        if bare.isalpha() and not line and max(bare) < "\u0100":
            if bare != words:  # the word is a chunk itself, and often known as one
                return self.chunks[bare] + self._piece(words[len(bare) :])
            return self._tokens((words.lower() if self.lower else " " + words).encode().decode("latin-1").translate(self.letters))
        pieces = _PIECE.findall(words)
        if sum(map(len, pieces)) != len(words) or not (line or words):
            return None
        if self.lower:
            return b"".join([self._piece(p.lower()) for p in pieces])
        pieces = ["\n", *pieces] if line else [" " + pieces[0], *pieces[1:]]
        return b"".join([self._piece(p) for p in pieces])

    def _find(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # letters that stand for themselves
            return array("I", map(_ID, self.tokenize(chunk.lower() if self.lower else "\u0120" + chunk))).tobytes()
        if (raw := self._chunk(chunk)) is None:
            raw = self._whole([chunk if chunk[:1] == "\n" else " " + chunk])[0]
        return raw

    def _text(self, text: str) -> bytes:
        if not splittable(text):
            return self._whole([text])[0]
        if self.lower and _latin(text):  # nothing there composes, and each letter has one lower case
            text = text.lower()
        parts = chunks_of(text)
        raws = [self._head(parts[0])]
        for at in range(1, len(parts), _SLICE):
            if len(self.chunks) >= self.most:
                self.chunks.old = {}
                self.chunks = Found(self._find, self.chunks)
            raws += map(self.chunks.__getitem__, parts[at : at + _SLICE])
        return b"".join(raws)

    def _head(self, chunk: str) -> bytes:
        """The ids of a text's first chunk, which has no space before it."""
        pieces = _PIECE.findall(chunk)
        if sum(map(len, pieces)) != len(chunk):
            return self._whole([chunk])[0]
        return b"".join([self._piece(p.lower() if self.lower else p) for p in pieces])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raws = []
        for text in texts:
            key = hash(text)
            if (known := self.copies.get(key)) is None or known[0] != text:
                raw = self._text(text)
                if self.seen.get(key) is None:
                    self.seen.put(key, True)
                elif len(text) < 1 << 16:  # met before: a copy of a document that has many, perhaps
                    self.copies.put(key, (text, raw))
            else:
                raw = known[1]
            raws.append(raw)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        return np.frombuffer(b"".join(raws), "<u4"), np.concatenate([[0], np.cumsum(sizes)])
