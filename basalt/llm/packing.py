"""Best-fit packing of token sequences: minimum bin slack.

Lengths, not documents, are packed: their histogram has at most `capacity` entries, however many
documents there are.  For each bin a subset-sum dynamic program over bitsets finds the fullest
combination of the lengths that are left; it is taken as often as the histogram allows.  Several ways to
order this are planned and the one with the fewest bins is taken.  Pieces are then numbered within their length and look up their place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import pieces, texts_of, written
from .tokenizing import encoder

_RANK_BITS = 48


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to room: length -> times."""
    mask, reach = (1 << (room + 1)) - 1, 1
    stages = []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        stages.append((length, reach))
        left, k = min(counts[length], room // length), 1
        while left:  # k copies at once, in powers of two
            k = min(k, left)
            reach |= (reach << (k * length)) & mask
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        n = 0
        while not before >> (target - n * length) & 1:
            n += 1
        if n:
            chosen[length] = n
            target -= n * length
    return chosen


def fill(counts: dict[int, int], capacity: int, layers: list[int], seeded: bool) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack, layer by layer: first with lengths over layers[0] alone, then with those over layers[1] that are left, and so on.

    In each layer the bins that are there get the fullest combination of the layer's lengths that their room takes, the smallest rooms
    first; what is left gets new bins.  These begin with the longest length (seeded) or with none.  Small lengths so stay for the
    gaps that nothing else fills.  With a layer for each length this is best fit decreasing.
    """
    counts = {x: n for x, n in counts.items() if n}
    bins: list[tuple[int, dict[int, int], int]] = []  # room, combination, times
    for least in layers:
        some = {x: counts.pop(x) for x in [x for x in counts if x > least]}
        if not some:
            continue
        opened, bins = sorted(bins, key=lambda b: b[0]), []

        def take(room: int, chosen: dict[int, int], add: dict[int, int], most: int | None) -> int:
            times = min([some[x] // n for x, n in add.items()] + ([most] if most else []))  # noqa: B023
            both = dict(chosen)
            for x, n in add.items():
                both[x] = both.get(x, 0) + n
                some[x] -= n * times  # noqa: B023
                if not some[x]:  # noqa: B023
                    del some[x]  # noqa: B023
            bins.append((room - sum(x * n for x, n in add.items()), both, times))  # noqa: B023
            return times

        for room, chosen, times in opened:
            while times:
                add = fullest(some, room) if some and room > least else {}
                times -= take(room, chosen, add, times)
        while some:
            seed = max(some) if seeded else 0
            add = fullest(some | ({seed: some[seed] - 1} if seed else {}), capacity - seed)
            if seed:
                add[seed] = add.get(seed, 0) + 1
            take(capacity, {}, add, None)
    return [(chosen, times) for _, chosen, times in bins]


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many bins each fills; together they use up counts.

    Of several ways of layering that with the fewest bins is taken.  One is best fit decreasing, so there are never more bins than that
    needs.
    """
    halves = [capacity >> k for k in range(1, capacity.bit_length())]
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best: list[tuple[dict[int, int], int]] = []
    for layers, seeded in (([0], True), ([*halves, 0], True), ([capacity // 4, capacity // 16, 0], True), ([0], False), ([*halves, 0], False), ([capacity // 4, capacity // 16, 0], False), ([*range(capacity, -1, -1)], True)):
        bins = fill(counts, capacity, layers, seeded)
        if not best or sum(n for _, n in bins) < sum(n for _, n in best):
            best = bins
        if sum(n for _, n in best) == least:
            break
    return best


def places(bins: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Rows by length and rank of the first piece: key, rank, first bin, copies a bin, offset."""
    rows, used, first = [], {}, 0
    for chosen, times in bins:
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            at = used.get(length, 0)
            rows.append(((length << _RANK_BITS) + at, at, first, n, offset))
            used[length] = at + n * times
            offset += n * length
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T)


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only a document over capacity is cut, and its first piece may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))] if n else []


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most capacity tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null or
    empty text is its end id alone.  A null doc_id stays null, repeated rows are packed each on its
    own, other columns are ignored, and an empty table gives no rows.  Equal lengths are interchangeable;
    which of them stands where follows the order in which they were read.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, seen, part = encoder(tokenizer), {}, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        for batch in pieces(batches, "text"):
            ids, begins = own_encoder.encode(texts_of(batch))
            out: list[tuple] = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                own = np.concatenate([ids[a:b], end])
                for k, (start, n) in enumerate(cut_lengths(len(own), capacity)):
                    out.append((doc, k, start, n, zlib.crc32(own[start : start + n]), part, seen.get(n, 0)))
                    seen[n] = seen.get(n, 0) + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    table = written(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenize, schema), "pieces")
    counted = written(table.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    key, rank, first, copies, offset = places(plan_bins(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, (lengths << _RANK_BITS) + ranks, "right") - 1
            i = ranks - rank[at]
            made = [first[at] + i // copies[at], offset[at] + i % copies[at] * lengths]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:5]), *map(pa.array, made)], [*batch.schema.names[:5], "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = table.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
