"""Byte-level BPE in numpy: padded matrices of pieces, one merge a row and round.

Pieces of like lengths stand in one matrix of part ids, a row each.  Every round finds each row's
leftmost pair of the lowest rank, replaces it by its merged part and closes the gap, so a matrix
loses one column a round; rows without a pair leave it.  Ranks of neighbours come from a hash table
of all pairs of the vocabulary, and only the two pairs beside a merge are looked up anew.

Pieces over LONG bytes would need as many rounds as bytes.  A matrix of one such row merges all pairs of its lowest
rank in a round, from the left up to the first that forms a pair of a lower rank, which would have come before the next.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pieces, texts_of
from .tokenizing import _PIECE, Recent, splittable

LONG = 2048
_NONE = np.int32(np.iinfo(np.int32).max)
_ROUND_CELLS = 1 << 21  # cells of a matrix at most
#: The pattern whose matches never cross a space that follows a character other than white space.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PairTable:
    """Open addressing: (left id, right id) -> id of the merged part, which is its rank too."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [((left << 32) | right, rank) for part, rank in ranks.items() for k in range(1, len(part)) if (left := ranks.get(part[:k])) is not None and (right := ranks.get(part[k:])) is not None]
        keys, values = (np.array(x, t) for x, t in zip(zip(*pairs, strict=True), (np.uint64, np.int32), strict=True))
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == np.iinfo(np.uint64).max
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            one = one[free[one]]
            self.keys[at[one]], self.values[at[one]] = keys[one], values[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids; the largest int32 where there is none, as beside padding (-1)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != np.iinfo(np.uint64).max))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen != np.iinfo(np.uint64).max)]
        return out


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.parts = [b""] * (max(ranks.values()) + 1)
        for part, rank in ranks.items():
            self.parts[rank] = part
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def _matrix(self, some: list[bytes], width: int) -> list[bytes]:
        out: list[bytes] = [b""] * len(some)
        flat = self.bytes[np.frombuffer(b"".join(some), np.uint8)]
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        ids = np.full((len(some), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = flat
        rank = np.full((len(some), width), _NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(some), -1)
            rank[:, :-1][ids[:, 1:] < 0] = _NONE
        rows = np.arange(len(some))
        while len(rows):
            at = rank.argmin(1)  # the first of the lowest: the leftmost
            line = np.arange(len(rows))
            low = rank[line, at]
            if (done := low == _NONE).any():
                for k in np.flatnonzero(done).tolist():
                    row = ids[k]
                    out[rows[k]] = row[row >= 0].astype("<u4").tobytes()
                keep = ~done
                rows, ids, rank, at, low = rows[keep], ids[keep], rank[keep], at[keep], low[keep]
                line = np.arange(len(rows))
            if not len(rows):
                break
            wide = ids.shape[1]
            ids[line, at] = low
            cells = np.ones(ids.shape, bool)
            cells[line, at + 1] = False
            ids = ids[cells].reshape(len(rows), wide - 1)
            cells[line, at + 1], cells[line, at] = True, False
            rank = rank[cells].reshape(len(rows), wide - 1)
            for side in (at - 1, at):  # the pairs that end and begin with the new part
                ok = np.flatnonzero((side >= 0) & (side + 1 < wide - 1))
                left, right = ids[ok, side[ok]], ids[ok, side[ok] + 1]
                rank[ok, side[ok]] = np.where(right < 0, _NONE, self.pairs.find(left, right))
        return out

    def _row(self, piece: bytes) -> bytes:
        """One long piece, with all merges of a rank in a round."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        rank = self.pairs.find(ids[:-1], ids[1:])
        while len(rank) and (low := rank.min()) != _NONE:
            at = np.flatnonzero(rank == low)
            run = np.concatenate([[True], np.diff(at) > 1])  # pairs that share a part: every other one
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            beside = np.concatenate([[False], np.diff(at) == 2])  # the part before is new, too
            left = np.where(beside, low, ids[np.maximum(at - 1, 0)])
            before = np.where(at > 0, self.pairs.find(left, np.full(len(at), low, np.int32)), _NONE)
            ends = at + 2 < len(ids)
            after = np.where(ends, self.pairs.find(np.full(len(at), low, np.int32), ids[np.minimum(at + 2, len(ids) - 1)]), _NONE)
            sooner = np.flatnonzero(np.minimum(before, after) < low)
            at = at[: sooner[0] + 1] if len(sooner) else at
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, place = ids[keep], at - np.arange(len(at))
            rank = rank[keep[1:]]  # of each pair that is left, but for those beside a merge
            for side in (place - 1, place):
                side = side[(side >= 0) & (side < len(rank))]
                rank[side] = self.pairs.find(ids[side], ids[side + 1])
        return ids.astype("<u4").tobytes()

    def encode_pieces(self, some: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = [b""] * len(some)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(some):
            if (whole := self.ranks.get(piece)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[k] = self._row(piece)
            elif piece:
                n = len(piece)
                buckets.setdefault(n if n <= 12 else -(-n // (step := 1 << (n.bit_length() - 3))) * step, []).append(k)
        for width, members in buckets.items():
            most = max(1, _ROUND_CELLS // width)
            for lo in range(0, len(members), most):
                part = members[lo : lo + most]
                for k, raw in zip(part, self._matrix([some[k] for k in part], width), strict=True):
                    out[k] = raw
        return out


@lru_cache(2)
def load_ranks(path: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})


def cut(texts: pa.Array) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """The distinct chunks, each chunk's number, the first chunks and where each text's chunks begin."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    begins = np.asarray(lists.offsets, np.int64)
    coded = lists.flatten().dictionary_encode()
    numbers = np.asarray(coded.indices, np.int64)
    return coded.dictionary.to_pylist(), numbers, pc.list_element(lists, 0).to_pylist(), begins - begins[0]


def gather(parts: list[bytes], numbers: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of parts[n] for each n of numbers, one after another, and where each text's ids begin."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), "<u4")
    starts = np.cumsum(sizes) - sizes
    n = sizes[numbers]
    ends = np.cumsum(n)
    at = np.repeat(starts[numbers] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[at], np.concatenate([[0], ends])[begins]


@lru_cache(2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """This worker's encoder; what it has learned serves the worker's later tasks."""
    return TextEncoder(path, pattern)


class TextEncoder:
    def __init__(self, path: str, pattern: str):
        self.bpe, self.pattern = load_ranks(path), regex.compile(pattern)
        self.spaced = pattern == SPACED
        self.chunks, self.known = Recent(200_000), Recent(150_000)

    def _pieces(self, chunk: str) -> list[str]:
        """The pattern's matches in a chunk, with the space or line feed before it."""
        line = chunk[:1] == "\n"
        words = chunk[line:]
        plain = _PIECE.findall(words)
        if sum(map(len, plain)) == len(words) and (line or words):
            return ["\n", *plain] if line else [" " + plain[0], *plain[1:]]
        return self.pattern.findall(chunk if line else " " + chunk)

    def _encode(self, lists: list[list[str]]) -> list[bytes]:
        found: dict[str, bytes | None] = {}
        for pieces_ in lists:
            for p in pieces_:
                if p not in found:
                    found[p] = self.known.get(p)
        new = [p for p, raw in found.items() if raw is None]
        for p, raw in zip(new, self.bpe.encode_pieces([p.encode() for p in new]), strict=True):
            found[p] = raw
            if len(p) < 64:
                self.known.put(p, raw)
        return [b"".join([found[p] for p in pieces_]) for pieces_ in lists]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin."""
        ok = np.array([self.spaced and splittable(t) for t in texts], bool)
        distinct, numbers, first, begins = cut(pa.array([t for t, k in zip(texts, ok, strict=True) if k], pa.large_string()))
        parts = list(map(self.chunks.get, distinct))
        new = [i for i, raw in enumerate(parts) if raw is None]
        for i, raw in zip(new, self._encode([self._pieces(distinct[i]) for i in new]), strict=True):
            parts[i] = raw
            self.chunks.put(distinct[i], raw)
        numbers[begins[:-1]] = len(parts) + np.arange(len(first))  # no space before these
        parts += self._encode([self.pattern.findall(t) for t in first])
        ids, ends = gather(parts, numbers, begins)
        if ok.all():
            return ids, ends
        whole = iter(self._encode([self.pattern.findall(t) for t, k in zip(texts, ok, strict=True) if not k]))
        at = iter(range(len(first)))
        out = [ids[ends[j := next(at)] : ends[j + 1]] if k else np.frombuffer(next(whole), "<u4") for k in ok]
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def decode(self, ids: np.ndarray) -> bytes:
        parts = self.bpe.parts
        return b"".join([parts[i] for i in ids.tolist()])


def encode_documents(documents: DataFrame, ranks: str, pattern: str = SPACED, keep_ids: bool = False) -> DataFrame:
    """Encode every whole text of documents (doc_id, text), then decode the ids.

    Returns doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 and,
    with keep_ids, ids_le32.  A null text is empty and has no ids; rows, null or repeated doc_ids
    included, come back one each; other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids_le32 binary" * keep_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(ranks, pattern)
        for batch in pieces(batches, "text"):
            ids, begins = encoder.encode(texts_of(batch))
            own = [ids[a:b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            raw = [x.tobytes() for x in own]
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) for x in own], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in own], pa.string()),
                *([pa.array(raw, pa.binary())] * keep_ids),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids_le32"][: len(columns)])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, schema)
