"""Which hashed tokens of a document also stand in others: one shuffle of packed tokens.

A task numbers its documents (`ref` = task number and place) and sends their 64-bit tokens, sorted
and packed, to the bucket of the token's value; a bucket sees all documents of a token and sends
those of two or more back, packed, to the bucket of the document.  A token that `cap` documents of
one task have is known to be common: its documents get it without a journey, and the bucket only a
mark.  So a bucket gets fewer than `cap` entries of a token from a task, however common the token is.

Each returned token carries min(number of documents, cap), the same for all who have it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

from ._common import release_memory

FLUSH = 800_000  # tokens at once in a task
_MARK = np.uint32(0xFFFFFFFF)
SCHEMA = "kind int, part int, blob binary, doc_id long, n long, sig binary, ref long, first boolean"
_ARROW = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("ref", pa.int64()), ("first", pa.bool_())]
)
DOCUMENT, TOKENS, RETURNED = 0, 1, 2


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed string, byte planes apart so that like bytes stand together."""
    head = ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(len(head).to_bytes(2, "little") + head + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 2 + int.from_bytes(raw[:2], "little")
    out = []
    for item in raw[2:at].decode().split(","):
        kind, n = item.split(":")
        dtype, n = np.dtype(kind), int(n)
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += n * dtype.itemsize
    return out


def bucket(tokens: np.ndarray, n: int) -> np.ndarray:
    """Buckets in the order of the tokens."""
    return ((tokens >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def home(refs: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document."""
    return bucket(refs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), n)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def rows(kind: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(parts)
    columns = [pa.array([kind] * n, pa.int32()), pa.array([p for p, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary()), *(pa.nulls(n, t) for t in _ARROW.types[3:])]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def documents(part: np.ndarray, doc_id, n, sig, ref, first, note=None) -> pa.RecordBatch:
    """Rows of documents; note is what `blob` holds for them."""
    columns = [pa.array([DOCUMENT] * len(part), pa.int32()), pa.array(part, pa.int32()), note or [None] * len(part), doc_id, n, sig, ref, first]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def returned(tokens: np.ndarray, refs: np.ndarray, common: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """Tokens on their way to their documents' buckets."""
    to = home(refs, n)
    order = np.lexsort((refs, to))
    tokens, refs, common, to = tokens[order], refs[order], common[order], to[order]
    edges = np.append(runs(to), len(to))
    return [(int(to[a]), pack(refs[a:b], tokens[a:b], common[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


class Sender:
    """A task's tokens, document by document."""

    def __init__(self, task: int, buckets: int, cap: int):
        self.base, self.buckets, self.cap = task << 32, buckets, cap
        self.count, self.held, self.waiting = 0, 0, []

    def add(self, tokens: np.ndarray) -> int:
        """Take a document's distinct tokens; its ref."""
        self.waiting.append((self.count, tokens))
        self.count += 1
        self.held += len(tokens)
        return self.base + self.count - 1

    def flush(self, force: bool = True) -> list[pa.RecordBatch]:
        if not self.held or not force and self.held < FLUSH:
            return []
        tokens = np.concatenate([t for _, t in self.waiting])
        place = np.repeat(np.array([k for k, _ in self.waiting], np.uint32), [len(t) for _, t in self.waiting])
        self.waiting, self.held = [], 0
        order = np.argsort(tokens, kind="stable")
        tokens, place = tokens[order], place[order]
        starts = runs(tokens)
        sizes = np.diff(np.append(starts, len(tokens)))
        out, common = [], np.repeat(sizes >= self.cap, sizes)
        if common.any():
            direct = returned(tokens[common], self.base + place[common].astype(np.int64), np.full(int(common.sum()), self.cap, np.uint8), self.buckets)
            out.append(rows(RETURNED, direct))
            mark = np.zeros(len(tokens), bool)
            mark[starts[sizes >= self.cap]] = True
            place = np.where(mark, _MARK, place)
            keep = ~common | mark
            tokens, place = tokens[keep], place[keep]
        to = bucket(tokens, self.buckets)
        edges = np.append(runs(to), len(to))
        out.append(rows(TOKENS, [(int(to[a]), pack(tokens[a:b], place[a:b], np.array([self.base]))) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]))
        return out


def share(buckets: int, cap: int):
    """For applyInArrow by part: keeps what stands in two documents at least, and lets the rest pass."""

    def reduce(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        out = [table.filter(pa.array(kinds != TOKENS))]
        blobs = table.filter(pa.array(kinds == TOKENS)).column("blob").to_pylist()
        if blobs:
            got = [unpack(b) for b in blobs]
            tokens = np.concatenate([t for t, _, _ in got])
            refs = np.concatenate([np.where(p == _MARK, -1, base[0] + p.astype(np.int64)) for _, p, base in got])
            order = np.argsort(tokens, kind="stable")
            tokens, refs = tokens[order], refs[order]
            starts = runs(tokens)
            sizes = np.diff(np.append(starts, len(tokens)))
            known = np.maximum.reduceat(refs < 0, starts)
            keep = np.repeat(known | (sizes > 1), sizes) & (refs >= 0)
            common = np.repeat(np.where(known, cap, np.minimum(sizes, cap)).astype(np.uint8), sizes)
            if keep.any():
                out.append(pa.Table.from_batches([rows(RETURNED, returned(tokens[keep], refs[keep], common[keep], buckets))]))
            del got, tokens, refs, order, starts, sizes, known, keep, common
            release_memory()
        return pa.concat_tables([t.cast(_ARROW) for t in out])

    return reduce


def received(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's documents: refs, where each one's tokens begin, tokens, how common they are."""
    got = [unpack(b) for b in blobs]
    refs, tokens, common = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((tokens, refs))
    refs, tokens, common = refs[order], tokens[order], common[order]
    starts = runs(refs)
    return refs[starts], np.append(starts, len(refs)), tokens, common
