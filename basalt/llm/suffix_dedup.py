"""Exact removal of passages that repeat across documents, by longest previous factors.

A passage is any run of `length` bytes.  Every such run has one anchor: the leftmost of its grams with
the smallest hash.  Equal runs have equal anchors, so runs can be brought together by anchor:

1. Each document's anchors are hashed; those in two documents come back (shared_tokens).
2. Around each of those a document's runs form one short segment.  Segments go to the bucket of the
   anchor; of segments of one task that are equal byte by byte only the smallest document's goes, the others are removed at once.
3. A bucket sorts the suffixes of its distinct segments, as deep as a run is long.  In suffix order the previous and the
   next suffix of a smaller document give the longest previous factor of each (longest_previous); where that is a run's length,
   the run is removed wherever its segment stands, so all but the first document's copy go.
4. Removed runs go back to their documents, whose bytes are then cut.

Nothing depends on which document comes to which task, and a passage common to a third of all
documents costs a bucket a segment for each task, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import shared_tokens as S
from ._common import buckets_of, by_bucket, pieces

_CHUNK = 1 << 20  # positions at once; a place must fit in _PLACE
_PLACE = np.uint64((1 << 24) - 1)
_TOKEN = ~np.uint64(0xFFFF)  # 48 bits tell anchors apart well enough: those that meet by chance only cost a look
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_SORTED = 1 << 20  # bytes whose suffixes are sorted at once


def gram_of(length: int) -> int:
    """How long an anchor is: 18 bytes for runs of 50."""
    return max(8, length * 9 // 25)


def words8(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each position on as a number."""
    return np.ndarray((max(0, len(data) - 7),), order, np.ascontiguousarray(data).data if len(data) else b"", 0, (1,))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = max(0, len(data) - gram + 1)
    at = words8(data)
    total = np.zeros(n, np.uint64)
    for k, offset in enumerate([*range(0, gram - 8, 8), gram - 8]):
        total ^= at[offset : offset + n]
        total *= _ODD[k % 5]
        total ^= total >> np.uint64(29 + k % 3)
    total *= _ODD[4]
    return total ^ (total >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents end to end: anchors' hashes, and the first and last run (by where it begins) that each stands for."""
    gram = gram_of(length)
    width = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.ones(len(data) - length + 1, bool)
    for k in range(1, length):  # runs that cross an end
        cut = ends[:-1] - k
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    found = []
    for lo in range(0, len(inside), _CHUNK):
        hi = min(len(inside), lo + _CHUNK)
        hashed = gram_hashes(data[lo : hi + length - 1], gram)
        low = (hashed & ~_PLACE) | np.arange(len(hashed), dtype=np.uint64)  # of equal ones the leftmost is the smallest
        reach = 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: hi - lo], low[width - reach : width - reach + hi - lo])
        place = (low & _PLACE).astype(np.int64)
        ok = inside[lo:hi]
        begins = ok & np.concatenate([[True], (place[1:] != place[:-1]) | ~ok[:-1]])
        last = ok & np.concatenate([(place[1:] != place[:-1]) | ~ok[1:], [True]])
        first = np.flatnonzero(begins)
        found.append((hashed[place[first]], first + lo, np.flatnonzero(last) + lo))
    token, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    token = (token ^ (token >> np.uint64(31))) * _ODD[2]  # anchors have small hashes; these are spread evenly
    return (token ^ (token >> np.uint64(29))) * _ODD[3] & _TOKEN, first, last


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of some ranges."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def range_hashes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each of some byte strings that stand end to end."""
    out = np.zeros(len(sizes), np.uint64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        part = data[base : int(ends[hi - 1])]
        power = np.full(len(part) + 1, _ODD[0])
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        end = ends[lo:hi] - base
        begin = end - sizes[lo:hi]
        out[lo:hi] = (total[end] - total[begin]) * power[len(part) - begin]
        lo = hi
    return (out ^ (out >> np.uint64(31))) * _ODD[1] + sizes.astype(np.uint64)


def nearest_smaller(value: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place the smallest of `common` on the way to the nearest place before it whose value is smaller, 0 without one.

    common[k] belongs to the step from k - 1 to k.  All places look at once: one whose candidate isn't smaller takes that one's
    candidate, as all between are no smaller either, so ways double from round to round.
    """
    to, least = np.arange(len(value)) - 1, common.copy()
    seeks = np.arange(1, len(value))
    seeks = seeks[value[to[seeks]] >= value[seeks]]
    while len(seeks):
        over = to[seeks]
        shorter, further = np.minimum(least[seeks], least[over]), to[over]
        least[seeks], to[seeks] = shorter, further
        seeks = seeks[further >= 0]
        seeks = seeks[value[to[seeks]] >= value[seeks]]
    least[to < 0] = 0
    return least


def longest_previous(data: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor of the suffix at each start, as far as `length` bytes: how much of it begins a suffix of a smaller owner too.

    Suffixes are sorted by their first `length` bytes.  Of all with a smaller owner the one that has most in common
    with a suffix is the nearest before or the nearest after it in that order: the previous and the next smaller position.
    """
    whole = np.ndarray((max(0, len(data) - length + 1),), f"S{length}", np.ascontiguousarray(data).data if len(data) else b"", 0, (1,))
    rows = whole[starts]
    order = np.argsort(rows)
    own = owner[order]
    letters = rows[order].view(np.uint8).reshape(-1, length)
    differ = letters[1:] != letters[:-1]
    common = np.where(differ.any(1), differ.argmax(1), length)  # of neighbours
    before = nearest_smaller(own, np.concatenate([[0], common])[: len(own)])
    after = nearest_smaller(own[::-1], np.concatenate([[0], common[::-1]])[: len(own)])[::-1]
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def equal_runs(order: np.ndarray, token: np.ndarray, hashed: np.ndarray, begin: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each segment, in an order, has the anchor and the bytes of the one before; hashes choose what is compared."""
    a, b = order[1:], order[:-1]
    at = np.flatnonzero((token[a] == token[b]) & (hashed[a] == hashed[b]) & (size[a] == size[b]))
    out = np.zeros(len(order), bool)
    for some in np.array_split(at, max(1, int(size[a[at]].sum()) // _CHUNK)):
        if len(some):
            n = size[a[some]]
            equal = data[spread(begin[a[some]], n)] == data[spread(begin[b[some]], n)]
            out[1 + some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


def match_segments(token: np.ndarray, doc: np.ndarray, size: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Segments end to end in data: (segment, offset, how many bytes) of what an earlier document has."""
    begin = np.cumsum(size) - size
    hashed = range_hashes(data, size)
    order = np.lexsort((doc, hashed, token))
    same = equal_runs(order, token, hashed, begin, size, data)
    least = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))  # of each kind of segment the smallest document's stands first
    later = doc[order] > doc[order][least]
    yield order[later], np.zeros(int(later.sum()), np.int64), size[order][later]
    kinds = order[~same]
    t = token[kinds]
    starts = S.runs(t)
    several = np.repeat(np.diff(np.append(starts, len(t))) > 1, np.diff(np.append(starts, len(t))))
    kinds, t = kinds[several], t[several]
    member = order[~later]  # occurrences in the smallest document
    of = order[least][~later]
    by_kind = np.argsort(of, kind="stable")
    of_sorted = of[by_kind]
    total = np.cumsum(size[kinds])
    cuts = [0]
    while cuts[-1] < len(kinds):
        k = int(np.searchsorted(total, (total[cuts[-1] - 1] if cuts[-1] else 0) + _SORTED, "right"))
        k = max(k, cuts[-1] + 1)
        while k < len(kinds) and t[k] == t[k - 1]:  # a token's segments stay together
            k += 1
        cuts.append(k)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = kinds[a:b]
        text = data[spread(begin[some], size[some])]
        n = size[some] - length + 1
        at = np.cumsum(size[some]) - size[some]
        windows = spread(at, n)
        segment = np.repeat(np.arange(len(some)), n)
        hit = longest_previous(text, windows, doc[some][segment], length) >= length
        first = hit & np.concatenate([[True], ~hit[:-1] | (segment[1:] != segment[:-1])])
        last = hit & np.concatenate([~hit[1:] | (segment[1:] != segment[:-1]), [True]])
        f, l = np.flatnonzero(first), np.flatnonzero(last)
        kind, offset, width = some[segment[f]], windows[f] - at[segment[f]], l - f + length
        lo, hi = np.searchsorted(of_sorted, kind), np.searchsorted(of_sorted, kind, "right")
        yield member[by_kind[spread(lo, hi - lo)]], np.repeat(offset, hi - lo), np.repeat(width, hi - lo)


_ROWS = "kind int, part int, blob binary, doc_id long, h long"
_TYPES = [("kind", pa.int32()), ("part", pa.int32()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("h", pa.int64())]
_TEXT, _LIST, _SEGMENTS, _CUTS = range(4)


def _parsed(schema: str) -> list[StructField]:
    return list(StructType.fromDDL(schema).fields)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_TYPES)], [n for n, _ in _TYPES])


def _key_bucket(doc_id: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    return S.home(doc_id ^ h, n)


def _by_document(doc_id: np.ndarray, h: np.ndarray, n: int, *columns: np.ndarray) -> list[tuple]:
    """Cuts on their way to their documents."""
    to = _key_bucket(doc_id, h, n)
    order = np.lexsort((h, doc_id, to))
    edges = np.append(S.runs(to[order]), len(order))
    return [(_CUTS, int(to[order[a]]), S.pack(doc_id[order[a:b]], h[order[a:b]].astype(np.int32), *(c[order[a:b]] for c in columns)), None, None) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if x is None else x for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _hash(text: bytes) -> int:
    """Tells the texts of one doc_id apart."""
    return xxhash.xxh32_intdigest(text) >> 1


def _end_to_end(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def remove_repeats(documents: DataFrame, length: int = 50, keep_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Remove from documents (doc_id, text) each byte of a run of `length` bytes that also begins in a document of smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with keep_text, kept_text
    (what is left; a character that was cut apart goes whole, null stays null) and row (a struct of the columns named in `keep`).  Texts count as UTF-8 bytes, null as empty; runs are judged on the input.
    Rows of one doc_id take nothing from each other.  A row with a null doc_id stays whole and takes nothing from others.
    Rows come back one each, other columns are ignored, an empty table gives no rows.  length is 16 at least.
    """
    if length < 16:
        raise ValueError("length must be 16 at least")
    buckets = buckets_of(documents)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = rows.where("doc_id is not null and octet_length(text) >= " + str(int(length)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = S.Sender(TaskContext.get().partitionId(), buckets, 2)
        for batch in pieces(batches, "text"):
            texts = _bytes_of(batch)
            data, ends = _end_to_end(texts)
            token, first, _ = anchors(data, ends, length)
            cut = np.searchsorted(first, np.concatenate([[0], ends]))
            ref = [sender.add(np.unique(token[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield S.documents(S.home(np.array(ref, np.int64), buckets), batch.column("doc_id"), [_hash(t) for t in texts], [None] * len(ref), ref, [True] * len(ref))
            yield from sender.flush(force=False)
        yield from sender.flush()

    def address(table: pa.Table) -> pa.Table:
        """Shared anchors by document, from the number of a document to its key."""
        kinds = np.asarray(table.column("kind"))
        blobs = table.filter(pa.array(kinds == S.RETURNED)).column("blob").to_pylist()
        out = []
        if blobs:
            docs = table.filter(pa.array(kinds == S.DOCUMENT))
            number, doc_id, h = (np.asarray(docs.column(c)).astype(np.int64) for c in ("ref", "doc_id", "n"))
            order = np.argsort(number)
            refs, begins, token, _ = S.received(blobs)
            at = order[np.searchsorted(number, refs, sorter=order)]
            to = _key_bucket(doc_id[at], h[at], buckets)
            by = np.argsort(to, kind="stable")
            edges = np.append(S.runs(to[by]), len(by))
            sizes = np.diff(begins)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                some = by[a:b]
                out.append((_LIST, int(to[some[0]]), S.pack(doc_id[at[some]], h[at[some]].astype(np.int32), sizes[some], token[spread(begins[some], sizes[some])]), None, None))
        return pa.Table.from_batches([_table(out)])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "text"):
            texts = _bytes_of(batch)
            h = np.array([_hash(t) for t in texts], np.int64)
            ids = batch.column("doc_id").to_pylist()
            to = _key_bucket(np.array([i or 0 for i in ids], np.int64), h, buckets)
            null = batch.column("text").is_null().to_pylist()
            yield _table([(_TEXT, p, None if no else pack.compress(t), i, x) for p, t, i, x, no in zip(to.tolist(), texts, ids, h.tolist(), null, strict=True)])

    def carry_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def kept():
            for batch in pieces(batches, "text"):
                held.append(batch)
                yield batch

        for made in carry(kept()):
            yield pa.RecordBatch.from_arrays([*made.columns, held.pop().column("row")], [*made.schema.names, "row"])

    def segments(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        lists: dict[tuple, np.ndarray] = {}
        for blob in table.filter(pa.array(kinds == _LIST)).column("blob").to_pylist():
            doc_id, h, sizes, token = S.unpack(blob)
            ends = np.cumsum(sizes)
            for k, key in enumerate(zip(doc_id.tolist(), h.tolist(), strict=True)):
                lists[key] = token[ends[k] - sizes[k] : ends[k]]
        texts = table.filter(pa.array(kinds == _TEXT))
        unpack, out, made, held, size = zstandard.ZstdDecompressor(), [], [], [], 0
        keys = list(zip(texts.column("doc_id").to_pylist(), texts.column("h").to_pylist(), strict=True))

        def take():
            data, ends = _end_to_end([t for _, t in held])
            token, first, last = anchors(data, ends, length)
            owner = np.searchsorted(ends, first, "right")
            edges = np.searchsorted(owner, np.arange(len(held) + 1))
            keep = np.zeros(len(token), bool)
            for k, (key, _) in enumerate(held):
                keep[edges[k] : edges[k + 1]] = np.isin(token[edges[k] : edges[k + 1]], lists[key])
            token, first, last, owner = token[keep], first[keep], last[keep], owner[keep]
            own = np.array([key for key, _ in held], np.int64).reshape(-1, 2)[owner]
            width = last - first + length
            made.append((token, own[:, 0], own[:, 1], first - (ends[owner] - np.array([len(t) for _, t in held])[owner]), width, data[spread(first, width)]))

        for key, blob in zip(keys, texts.column("blob").to_pylist(), strict=True):
            if key in lists:
                held.append((key, unpack.decompress(blob)))
                size += len(held[-1][1])
                if size > _CHUNK:
                    take()
                    held, size = [], 0
        if held:
            take()
        if made:
            token, doc_id, h, start, width, data = (np.concatenate(x) for x in zip(*made, strict=True))
            begin = np.cumsum(width) - width
            hashed = range_hashes(data, width)
            order = np.lexsort((doc_id, hashed, token))
            same = equal_runs(order, token, hashed, begin, width, data)
            least = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            later = doc_id[order] > doc_id[order][least]
            gone, sent = order[later], order[~later]
            if len(gone):
                out += _by_document(doc_id[gone], h[gone], buckets, start[gone], width[gone].astype(np.int32))
            sent = sent[np.argsort(token[sent], kind="stable")]
            to = S.bucket(token[sent], buckets)
            edges = np.append(S.runs(to), len(to))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                s = sent[a:b]
                out.append((_SEGMENTS, int(to[a]), S.pack((token[s] >> np.uint64(16)).astype(np.uint32), doc_id[s], h[s].astype(np.int32), start[s], width[s].astype(np.int32), data[spread(begin[s], width[s])], level=3), None, None))
        return pa.Table.from_batches([_table(out)])

    def match(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        out = [table.filter(pa.array(kinds == _CUTS))]
        blobs = table.filter(pa.array(kinds == _SEGMENTS)).column("blob").to_pylist()
        if blobs:
            token, doc_id, h, start, width, data = (np.concatenate(x) for x in zip(*map(S.unpack, blobs), strict=True))
            width, h = width.astype(np.int64), h.astype(np.int64)
            for segment, offset, size in match_segments(token, doc_id, width, data, length):
                if len(segment):
                    out.append(pa.Table.from_batches([_table(_by_document(doc_id[segment], h[segment], buckets, start[segment] + offset, size.astype(np.int32)))]))
        return pa.concat_tables([t.cast(pa.schema(_TYPES)) for t in out])

    def cut(table: pa.Table) -> pa.Table:
        kinds = np.asarray(table.column("kind"))
        texts = table.filter(pa.array(kinds == _TEXT))
        blobs = table.filter(pa.array(kinds == _CUTS)).column("blob").to_pylist()
        cuts: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        if blobs:
            doc_id, h, start, size = (np.concatenate(x) for x in zip(*map(S.unpack, blobs), strict=True))
            h = h.astype(np.int64)
            order = np.lexsort((start, h, doc_id))
            doc_id, h, start, size = doc_id[order], h[order], start[order], size[order]
            new = S.runs(np.stack([doc_id, h], 1).view("i8,i8").reshape(-1))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(h)], strict=True):
                cuts[int(doc_id[a]), int(h[a])] = start[a:b], start[a:b] + size[a:b]
        unpack, out = zstandard.ZstdDecompressor(), []
        for doc, x, blob in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "h", "blob")), strict=True):
            raw = b"" if blob is None else unpack.decompress(blob)
            kept, spans = raw, 0
            if (found := cuts.get((doc, x))) is not None:
                start, end = found[0], np.maximum.accumulate(found[1])
                first = np.concatenate([[True], start[1:] > end[:-1]])
                begins, ends = start[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)]
                spans, at, rest = len(begins), 0, []
                for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                    rest.append(raw[at:a])
                    at = b
                kept = b"".join([*rest, raw[at:]])
            out.append((doc, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text and blob is not None else None))
        types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
        made = {name: pa.array([r[k] for r in out], t) for k, (name, t) in enumerate(types[: 5 + keep_text])}
        return pa.table(made | ({"row": texts.column("row")} if keep_text else {}))

    shared = by_bucket(known.mapInArrow(send, S.SCHEMA), buckets).applyInArrow(S.share(buckets, 2), S.SCHEMA)
    lists = by_bucket(shared, buckets).applyInArrow(address, _ROWS)
    found = by_bucket(lists.unionByName(known.mapInArrow(carry, _ROWS)), buckets).applyInArrow(segments, _ROWS)
    cuts = by_bucket(found, buckets).applyInArrow(match, _ROWS)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if not keep_text:
        return by_bucket(cuts.unionByName(rows.mapInArrow(carry, _ROWS)), buckets).applyInArrow(cut, schema)
    whole = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.struct(*[F.col(f"`{c}`") for c in keep or ["doc_id"]]).alias("row"))
    row = whole.schema["row"].dataType
    carried = whole.mapInArrow(carry_row, StructType([*_parsed(_ROWS), StructField("row", row)]))
    made = cuts.withColumn("row", F.lit(None).cast(row)).unionByName(carried)
    return by_bucket(made, buckets).applyInArrow(cut, StructType([*_parsed(schema), StructField("kept_text", StringType()), StructField("row", row)]))


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, unnest(range(n - 49)) AS i, x FROM d WHERE n >= 50),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS w FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) < doc_id AS gone FROM w),
g AS (SELECT doc_id, i FROM m WHERE gone),
b AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM g),
s AS (SELECT doc_id, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b),
r AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS z FROM s GROUP BY doc_id, span),
q AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a)::BIGINT AS gone, count(*)::BIGINT AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(q.gone, 0)::BIGINT AS n_removed, coalesce(q.spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN q.a IS NULL THEN d.x ELSE
         array_to_string(list_transform(range(1, len(q.a) + 2), lambda k: substr(d.x, 2 * (CASE WHEN k = 1 THEN 0 ELSE q.z[k - 1] END) + 1,
           2 * ((CASE WHEN k = len(q.a) + 1 THEN d.n ELSE q.a[k] END) - (CASE WHEN k = 1 THEN 0 ELSE q.z[k - 1] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)
"""
