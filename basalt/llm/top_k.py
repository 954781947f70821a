"""Exact top-k search by columnar branch and bound.

Rows and queries become integers, are dealt by the nearest of a few centres and written in chunks, so that a
chunk's blocks and groups hold similar vectors.  A first pass scores each query against a bounded
sample of the candidates, whose k-th best is a floor under the query's final k-th best.  Pairs of chunks, read
from the shared folder, are then dealt out by name:

1. Branch: a block whose best possible score (centres and radii) lies below the floors of a group of queries is left out.
2. Bound: the rest stands in vertical layout.  Scores are summed a few dimensions at a time, heavy ones
   first; candidates and queries that the norms of the dimensions left can't lift to a floor are compacted away.
3. What is left joins the queries' best, which raises their floors for the blocks that follow.

No row is copied by a shuffle but to its chunk, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, written
from .vectors import centres_of, distances, sound_blocks

STEP = 16  # dimensions
BLOCK = 2048  # candidates
GROUP = 64  # queries
_EXACT = {np.float32: 2.0**24, np.float64: 2.0**53}  # below these sums of integers are exact
_LONG = np.iinfo(np.int64)


def whole(matrix: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each component, and which rows are too large for 32 bits (theirs stay as they are)."""
    wide = np.abs(matrix).max(1, initial=0) * scale >= 1 << 30
    return np.where(wide[:, None], matrix, np.floor(scale * np.where(wide[:, None], 0, matrix))), wide


def unlimited(matrix: np.ndarray, wide: bool, scale: int) -> np.ndarray:
    """The same as Python's integers."""
    big = lambda x: floor(scale * x) if abs(x) < 1 << 52 else scale * int(x)  # noqa: E731  from 2**52 on doubles are whole
    return np.array([[big(x) if wide else int(x) for x in row] for row in matrix.tolist()], object).reshape(matrix.shape)


class Rows:
    """A few rows of like dimension and their bounds."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, wide: bool):
        self.ids, self.matrix, self.wide = ids, matrix, wide
        if not wide:
            self.norm = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(1).max(initial=0)))
            self.centre = matrix.mean(0, dtype=np.float64)
            self.radius = float(np.sqrt(((matrix - self.centre) ** 2).sum(1).max(initial=0)))

    def most(self, other: Rows) -> float:
        """No score between the two is higher."""
        if self.wide or other.wide:
            return np.inf
        a, b = np.sqrt((self.centre**2).sum()), np.sqrt((other.centre**2).sum())
        return (float(self.centre @ other.centre) + a * other.radius + b * self.radius + self.radius * other.radius) * (1 + 1e-9) + 1e-6


def left_after(x: np.ndarray) -> np.ndarray:
    """Norms of the dimensions left after each step, rounded up."""
    squares = np.cumsum((x.astype(np.float64) ** 2)[:, ::-1], 1)[:, ::-1]
    return np.sqrt(np.concatenate([squares[:, STEP::STEP], np.zeros((len(x), 1))], 1)) * (1 + 1e-9) + 1e-9


class Search(Rows):
    """The best of a group of queries so far; `floors` are scores that a candidate must reach."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None, wide: bool = False, scale: int = 64):
        super().__init__(ids, queries, wide)
        self.k, self.scale, self.done, self.full = k, scale, 0, 0
        self.floors = np.full(len(ids), -np.inf) if floors is None else floors.copy()
        self.order = np.argsort(-(queries.astype(np.float64) ** 2).sum(0), kind="stable") if not wide else None  # heavy dimensions first
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, block: Rows) -> None:
        """Take in a block of candidates."""
        self.full += len(self.ids) * block.matrix.size
        if self.wide or block.wide or (bound := self.norm * block.norm) >= _EXACT[np.float64]:
            scores = unlimited(self.matrix, self.wide, self.scale) @ unlimited(block.matrix, block.wide, self.scale).T
            self.done += len(self.ids) * block.matrix.size
            self._keep(np.arange(len(self.ids)), block.ids, np.vectorize(lambda s: min(max(s, _LONG.min), _LONG.max), otypes=[np.int64])(scores))
            return
        if self.most(block) < self.floors.min():
            return
        kind = np.float32 if bound < _EXACT[np.float32] else np.float64
        queries, columns = self.matrix[:, self.order].astype(kind), block.matrix[:, self.order]
        left, near = left_after(columns), left_after(queries)
        columns = np.ascontiguousarray(columns.T, kind)
        line, at = np.arange(len(self.ids)), np.arange(len(block.ids))
        total = np.zeros((len(line), len(at)), kind)
        for n, lo in enumerate(range(0, len(self.order), STEP)):
            total += queries[line, lo : lo + STEP] @ columns[lo : lo + STEP]
            self.done += len(line) * len(at) * min(STEP, len(self.order) - lo)
            if lo + STEP < len(self.order):
                may = total + np.outer(near[line, n], left[at, n]) >= self.floors[line, None]
                some, rows = may.any(0), may.any(1)
                if some.mean() < 0.9 or rows.mean() < 0.9:
                    at, line, total = at[some], line[rows], total[rows][:, some]
                    columns = columns[:, some]
                if not len(at) or not len(line):
                    return
        self._keep(line, block.ids[at], np.rint(total).astype(np.int64))

    def _keep(self, line: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        row, at = np.nonzero((scores >= self.floors[line, None]) & (ids != self.ids[line, None]))  # a query's own vec_id may be on any number of rows
        if len(row):
            self.held.append((line[row], ids[at], scores[row, at]))
            self.count += len(row)
            if self.count > 8 * self.k * len(self.ids):
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query (place in the group), vec_id, score of the best so far; raises the floors."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        line, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, ~scores, line))  # ~s is -s - 1, which no long overflows
        line, ids, scores = line[order], ids[order], scores[order]
        begins = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        rank = np.arange(len(line)) - np.repeat(begins, np.diff(np.append(begins, len(line))))
        last = rank == self.k - 1
        self.floors[line[last]] = np.maximum(self.floors[line[last]], scores[last])
        keep = rank < self.k
        self.held, self.count = [(line[keep], ids[keep], scores[keep])], int(keep.sum())
        return self.held[0]


def blocks_of(table: pa.Table) -> Iterator[dict]:
    for r in table.to_pylist():
        yield r | {"ids": np.frombuffer(r["ids"], np.int64), "matrix": np.frombuffer(r["data"], r["kind"]).reshape(-1, r["dim"]), "floors": np.frombuffer(r["floors"] or b"")}


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, scale: int = 64, query_block: int = 2048, chunk: int = 1 << 16, sample: int = 2048, work: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score.

    Components become floor(scale * x).  Queries are the rows whose vec_id is divisible by `every`, candidates all
    rows but the query's own vec_id, of like dimension; ties go to the smaller vec_id.  Rows with a null vec_id, a
    null vector or a null or non-finite component take no part, repeated rows are candidates each, an
    empty table gives no rows.  Scores are exact however large the components are; those beyond a long count as
    the nearest long.

    `sample` bounds the rows that centres and first floors come from (fewer of vectors over 1024 dimensions);
    every row is searched.  `work` counts products computed, those of the first pass included, and those that all pairs would take.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), "embedding")
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"), F.max(F.size("embedding")).alias("dim")).first()
    sample = max(1, min(sample, size.n // 16, (2 << 20) // max(1, size.dim or 1)))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        for batch, some, matrix in sound_blocks(batches):
            ids = np.asarray(batch.column("id"), np.int64)[some]
            matrix, wide = whole(matrix, scale)
            for w in np.unique(wide).tolist():
                yield ids[wide == w], matrix[wide == w], w

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix, wide in numbers(batches):
            if not wide:
                yield pa.RecordBatch.from_pydict({"dim": [matrix.shape[1]], "ids": [ids.tobytes()], "data": [matrix.tobytes()]})

    drawn: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id", "embedding")).limit(sample).mapInArrow(raw, "dim long, ids binary, data binary").collect():
        drawn.setdefault(r.dim, []).append((np.frombuffer(r.ids, np.int64), np.frombuffer(r.data).reshape(-1, r.dim)))
    known = {dim: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for dim, parts in drawn.items()}
    centres = {dim: centres_of(matrix, max(1, min(256, isqrt(size.n) // 2))) for dim, (_, matrix) in known.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix, wide in numbers(batches):
            dim = matrix.shape[1]
            cell = distances(matrix, centres[dim]).argmin(1) if dim in centres and not wide else np.zeros(len(ids), np.int64)
            data = matrix if wide else matrix.astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(ids), pa.int64()), pa.array([wide] * len(ids)), pa.array(cell.astype(np.int64)), pa.array(ids), pa.array([x.tobytes() for x in data], pa.binary())], ["dim", "wide", "cell", "id", "data"])

    def pack(most: int, seek: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Runs of one cell as blocks; of queries, with their floors."""
            now, ids, data = None, [], []

            def out():
                dim, wide, _ = now
                matrix = np.frombuffer(b"".join(data), "<f8" if wide else "<i4").reshape(-1, dim)
                if not wide:
                    most_ = int(np.abs(matrix).max(initial=0))
                    matrix = matrix.astype("<i1" if most_ < 1 << 7 else "<i2" if most_ < 1 << 15 else "<i4")
                own, floors = np.array(ids, np.int64), b""
                if seek:
                    floors = np.full(len(own), -np.inf)
                    if dim in known and not wide and len(known[dim][0]) > k:
                        first = Search(own, matrix, k)
                        first.add(Rows(*known[dim], False))
                        first.best()
                        floors = first.floors
                        if work:
                            work[0].add(first.done)
                    floors = floors.tobytes()
                return pa.RecordBatch.from_pydict({"dim": [dim], "wide": [wide], "kind": [matrix.dtype.str], "ids": [own.tobytes()], "data": [matrix.tobytes()], "floors": pa.array([floors], pa.binary())})

            for batch in batches:
                for dim, wide, cell, i, x in zip(*(batch.column(c).to_pylist() for c in ("dim", "wide", "cell", "id", "data")), strict=True):
                    if (dim, wide, cell) != now or len(ids) == most:
                        if ids:
                            yield out()
                        now, ids, data = (dim, wide, cell), [], []
                    ids.append(i)
                    data.append(x)
            if ids:
                yield out()

        return run

    def chunks(some: DataFrame, n: int, each: int, name: str, most: int, seek: bool) -> list[list[str]]:
        """Write n rows in files of similar rows; the names of chunks of some `each` rows come back, one entry a file."""
        placed = some.mapInArrow(place, "dim long, wide boolean, cell long, id long, data binary")
        dealt = placed.repartitionByRange(max(1, -(-n // each)), "dim", "wide", "cell", "id").sortWithinPartitions("dim", "wide", "cell", "id")
        table = written(dealt.mapInArrow(pack(most, seek), "dim long, wide boolean, kind string, ids binary, data binary, floors binary"), name)
        files = sorted(table.groupBy(F.input_file_name()).agg(F.sum(F.octet_length("ids") / 8)).collect())
        out, held = [], each
        for file, size in files:
            if held + size > each:
                out.append([])
                held = 0
            out[-1].append(file)
            held += size
        return out

    given = chunks(rows, size.n, min(chunk, max(BLOCK, -(-size.n // (2 * partitions(spark))))), "candidates", BLOCK, False)
    asked = chunks(rows.where(F.col("id") % every == 0), size.q, query_block, "queries", GROUP, True)

    def load(files: list[str]) -> Iterator[dict]:
        for file in files:
            fs, path = pafs.FileSystem.from_uri(file)
            with fs.open_input_file(path) as f:
                yield from blocks_of(pq.read_table(f))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, blocks = None, []
        for batch in batches:
            for pair in batch.column("pair").to_pylist():
                if have != (have := pair // len(asked)):
                    blocks = [(r["dim"], Rows(r["ids"], r["matrix"], r["wide"])) for r in load(given[have])]
                for r in load(asked[pair % len(asked)]):
                    group = Search(r["ids"], r["matrix"], k, r["floors"], r["wide"], scale)
                    near = sorted(((-group.most(b), n) for n, (dim, b) in enumerate(blocks) if dim == r["dim"]))
                    for _, n in near:
                        group.add(blocks[n][1])
                    line, ids, scores = group.best()
                    if work:
                        work[0].add(group.done)
                        work[1].add(group.full)
                    if len(line):
                        yield pa.RecordBatch.from_arrays([pa.array(group.ids[line]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    pairs = len(given) * len(asked)
    met = spark.range(0, pairs, 1, max(1, min(pairs, 100_000))).select(F.col("id").alias("pair"))
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
