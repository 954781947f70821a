"""Near-duplicate vectors: an exact metric range join.

On the unit sphere a cosine is a distance, d = sqrt(2 - 2 cos), and links are pairs within the range e.

1. Equal vectors become one, with a weight, so copies cost nothing more.
2. Pivots (means of a bounded sample) partition the vectors into cells of the nearest pivot.  Each cell's distances to
   several pivots are measured, and a histogram of its distances to its own.
3. Cells of over `cell_rows` rows get pivots of their own, from a sample of theirs, and all is dealt again; so a few times.
   Neighbouring cells make up parts of `cell_rows` rows.  A cell that is still larger is cut into rings by the distance to its pivot, a ring
   that holds too many equal distances into parts by a hash.  Parts have an order; of a pair the vector of the earlier part is sent to the later.
4. A vector is replicated to another part only if the triangle inequality lets it have a partner in a cell there: its distance
   to every measured pivot is within e of the cell's, that to the cell's pivot within e of the ring's and at most 2 e over that
   to its own pivot.  On vectors without clusters that is every later part, which copies no more than a square grid of parts does.
5. Parts join independently, by the same bounds on rows and cells.  A cell's core, what lies within e / 2 of its pivot, is linked
   throughout, so its links are counted without comparing, and a group of near copies of any size costs its own size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, discard, partitions, written
from .vectors import centres_of, distances, sound_blocks, unite, units

_LOOSE = 1e-6  # how far distances may be off
_BINS = 512  # of a histogram of distances from 0 to 2
_MEASURED = 16  # pivots at most to which a cell's distances are measured


class Parts:
    """The plan of one dimension: pivots, what their cells hold, and the parts in order."""

    def __init__(self, pivots: np.ndarray, reach: float):
        self.pivots, self.reach, self.core, self.parts = pivots, reach, reach / 2 - 2 * _LOOSE, 0

    def distances(self, unit: np.ndarray) -> np.ndarray:
        """To all pivots; a dimension that the sample hasn't is one cell, of which nothing is known."""
        return distances(unit, self.pivots) if len(self.pivots) else np.full((len(unit), 1), 2.0)

    def _chain(self) -> list[int]:
        """Cells, each beside one that is near."""
        at, rest = [0], np.arange(1, len(self.low))
        while len(rest):
            k = int(((self.pivots[rest] - self.pivots[at[-1]]) ** 2).sum(1).argmin())
            at.append(int(rest[k]))
            rest = np.delete(rest, k)
        return at

    def cut(self, sizes: dict[int, tuple], cell_rows: int) -> None:
        """Deal the cells to parts, by the (n, low, high, histogram) of each."""
        count = max(1, len(self.pivots))
        self.low, self.high = (np.full((count, len(next(iter(sizes.values()))[k])), x) for k, x in ((1, np.inf), (2, -np.inf)))
        for cell, (_, low, high, _) in sizes.items():
            self.low[cell], self.high[cell] = low, high
        self.rings: dict[int, tuple] = {}  # large cells: bounds of rings, parts of each, their numbers
        self.bundle = np.full(count, -1)  # the part of a small cell
        self.chain, at, held = [c for c in self._chain() if c in sizes], 0, 0
        for cell in self.chain:
            n, _, _, histogram = sizes[cell]
            if held and held + n > cell_rows:
                at, held = at + 1, 0
            if n <= cell_rows:
                self.bundle[cell], held = at, held + n
                continue
            total, edges, split = np.cumsum(histogram), [0], []
            while edges[-1] < _BINS:
                before = total[edges[-1] - 1] if edges[-1] else 0
                edge = min(_BINS, max(edges[-1] + 1, int(np.searchsorted(total, before + cell_rows, "right"))))
                split.append(max(1, int(-(-(total[edge - 1] - before) // cell_rows))))
                edges.append(edge)
            bounds = np.array(edges) * 2.0 / _BINS
            bounds[-1] = 2.1
            self.rings[cell] = bounds, np.array(split), at + np.concatenate([[0], np.cumsum(split)])
            at += sum(split)
        self.parts = at + (held > 0)

    def part_of(self, cell: np.ndarray, r: np.ndarray, ids: np.ndarray) -> np.ndarray:
        part = self.bundle[cell]
        for c in np.unique(cell[part < 0]).tolist():
            bounds, split, first = self.rings[c]
            mine = cell == c
            ring = np.clip(np.searchsorted(bounds, r[mine], "right") - 1, 0, len(split) - 1)
            part[mine] = first[ring] + ids[mine] % split[ring]
        return part

    def may(self, d: np.ndarray, cell: np.ndarray, near: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For each row and each of some cells whether the triangle inequality lets the row have a partner there."""
        out = d[:, cells] <= near[:, None] + 2 * self.reach
        low, high = self.low[cells] - self.reach, self.high[cells] + self.reach
        for j in range(low.shape[1]):
            out &= (d[:, j, None] >= low[:, j]) & (d[:, j, None] <= high[:, j])
        return out | (cells == cell[:, None])

    def visits(self, d: np.ndarray, cell: np.ndarray, near: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each part the rows of earlier parts that may have a partner there."""
        may = self.may(d, cell, near, np.arange(len(self.low)))
        small = [c for c in self.chain if self.bundle[c] >= 0]
        if small:
            number = self.bundle[small]
            begins = np.flatnonzero(np.diff(number, prepend=-1))
            some = np.logical_or.reduceat(may[:, small], begins, axis=1)
            for k, p in enumerate(number[begins].tolist()):
                if len(sent := np.flatnonzero(some[:, k] & (part < p))):
                    yield p, sent
        for c, (bounds, split, first) in self.rings.items():
            some = np.flatnonzero(may[:, c] & (part < first[-1] - 1))
            to, inner = d[some, c], (cell[some] == c) & (near[some] <= self.core)
            for ring in range(len(split)):  # core rows needn't meet a ring that is all core
                ok = some[(to >= bounds[ring] - self.reach) & (to <= bounds[ring + 1] + self.reach) & ~(inner & (bounds[ring + 1] <= self.core))]
                for p in range(int(first[ring]), int(first[ring + 1])):
                    if len(sent := ok[part[ok] < p]):
                        yield p, sent


def near_duplicates(embeddings: DataFrame, least: float = 0.9, cell_rows: int | None = None, sample: int = 4096, most_pivots: int = 1024, deeper: int = 2, work: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """Links of cosine >= least among all rows: vec_id, n_links, component_id, kept.

    What single precision finds near is checked in double.  Null or zero vectors and those with a
    null or non-finite component link with nothing, as do vectors of another dimension; very large and very small
    components count like others.  Rows come back one each; a repeated vec_id is a vector of its own, a null one names a component
    only where all are null; an empty table gives no rows.  Other columns are ignored.

    `sample` bounds the vectors that pivots come from at a time (fewer of those over 2048 dimensions), cell_rows (by default a task's share, 256 to
    32768) a part's own rows; `deeper` is how often cells that hold more get pivots of their own.  `work` counts pairs compared and vectors sent.
    """
    spark = embeddings.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) * (1 + _LOOSE) + _LOOSE
    wide = embeddings.schema["embedding"].dataType.elementType.simpleString() == "double"
    source = "<f8" if wide else "<f4"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A key for each row, null where it links with nothing, and its components as they came."""
        seen: set[bytes] = set()
        for batch in batches:
            key, data = [None] * batch.num_rows, [None] * batch.num_rows
            for _, some, matrix in sound_blocks(iter([batch])):
                ok, _ = units(matrix)
                matrix = matrix[ok] + 0.0  # -0 becomes 0
                for k, x in zip(some[ok].tolist(), matrix.astype(source), strict=True):
                    data[k] = x.tobytes()
                    key[k] = hashlib.sha256(data[k]).digest()
            for k, x in enumerate(key):  # copies that a task has just met needn't carry their components
                if x in seen:
                    data[k] = None
                elif x is not None and len(seen) < 100_000:
                    seen.add(x)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(key, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "key", "data"])

    table = written(rows.mapInArrow(pack, "vec_id long, key binary, data binary"), "vectors")
    grouped = table.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("data", ignorenulls=True).alias("data"))
    single = written(grouped.select(F.monotonically_increasing_id().alias("id"), "key", "n", "least", "data"), "distinct")
    size = single.agg(F.count("*").alias("n"), F.max(F.octet_length("data")).alias("bytes")).first()
    cell_rows = cell_rows or int(np.clip(-(-size.n // partitions(spark)), 256, 32768))
    wanted = int(min(most_pivots, max(1, min(size.n, sample) // 8), max(4, -(-size.n // 64))))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]]:
        """ids, weights, components as they came and of length 1, cells and distances from their pivots, of like dimension."""
        for batch in batches:
            data = batch.column("data").to_pylist()
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            ids, n, cell, r = (np.asarray(batch.column(c)) for c in ("id", "n", "cell", "r"))
            for width in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == width)
                for lo in range(0, len(at), 4096):
                    some = at[lo : lo + 4096]
                    raw = [data[k] for k in some.tolist()]
                    yield ids[some], n[some], raw, units(np.frombuffer(b"".join(raw), source).reshape(len(some), -1).astype(np.float64))[1], cell[some], r[some]

    picked: dict[int, list] = {}
    for r in single.orderBy("key").limit(min(sample, max(1, (64 << 20) // max(1, size.bytes or 1)))).select("data").collect():
        x = np.frombuffer(r.data, source).astype(np.float64)
        picked.setdefault(len(x), []).append(units(x[None])[1][0])
    plans = {dim: Parts(centres_of(np.array(points), wanted), reach) for dim, points in picked.items()}
    fresh = lambda dim: plans.get(dim) or Parts(np.zeros((0, dim)), reach)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, raw, unit, _, _ in matrices(batches):
            d = fresh(unit.shape[1]).distances(unit)
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(raw, pa.binary()), pa.array(own), pa.array(d[np.arange(len(d)), own])], ["id", "n", "data", "cell", "r"])

    def placed(df: DataFrame) -> DataFrame:
        """Rows with their cells; written, as all that follows must agree on them."""
        return written(df.mapInArrow(place, "id long, n long, data binary, cell long, r double"), "placed")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, _, unit, own, near in matrices(batches):
            plan = fresh(dim := unit.shape[1])
            d = plan.distances(unit)
            for c in np.unique(own).tolist():
                mine = own == c
                core = mine & (near <= plan.core)
                seen = d[mine][:, :_MEASURED]
                bins = np.bincount(np.clip((near[mine] * _BINS / 2).astype(np.int64), 0, _BINS - 1), minlength=_BINS)
                yield pa.RecordBatch.from_pydict({"dim": [dim], "cell": [c], "n": [int(mine.sum())], "weight": [int(n[core].sum())], "head": [int(ids[core].min(initial=np.iinfo(np.int64).max))], "low": [seen.min(0).tobytes()], "high": [seen.max(0).tobytes()], "bins": [bins.tobytes()]})

    def merge(some: pa.Table) -> pa.Table:
        stack = lambda name, kind=np.float64: np.stack([np.frombuffer(x, kind) for x in some.column(name).to_pylist()])
        n, weight, head = (np.asarray(some.column(c)) for c in ("n", "weight", "head"))
        return pa.table({"dim": some.column("dim")[:1], "cell": some.column("cell")[:1], "n": [n.sum()], "weight": [weight.sum()], "head": [head.min()], "low": [stack("low").min(0).tobytes()], "high": [stack("high").max(0).tobytes()], "bins": [stack("bins", np.int64).sum(0).tobytes()]}).cast(cells_schema)

    cells = "dim long, cell long, n long, weight long, head long, low binary, high binary, bins binary"
    cells_schema = pa.schema([(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in cells.split(", ")])

    def measured_cells(df: DataFrame) -> list:
        return df.mapInArrow(measure, cells).groupBy("dim", "cell").applyInArrow(merge, cells).collect()  # a row a pivot

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A share of each large cell's rows, by a hash of their ids."""
        for ids, _, raw, unit, cell, _ in matrices(batches):
            share = np.array([large.get((unit.shape[1], c), (0, 0.0))[1] for c in cell.tolist()])
            at = np.flatnonzero((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)) < share * (1 << 20)).tolist()
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([unit.shape[1]] * len(at), pa.int64()), pa.array(cell[at]), pa.array([raw[k] for k in at], pa.binary())], ["dim", "cell", "data"])

    at_hand = placed(single.select("id", "n", "data", F.lit(0).cast("long").alias("cell"), F.lit(0.0).alias("r")))
    measured = measured_cells(at_hand)
    for _ in range(deeper):  # large cells get pivots of their own
        large = {}
        for r in measured:
            outside = int(np.frombuffer(r.bins, np.int64)[int(max(0.0, reach / 2) * _BINS / 2) + 1 :].sum())  # a core needn't be cut
            if outside > cell_rows and r.dim in plans:
                large[r.dim, r.cell] = r.n, min(1.0, 64 * -(-r.n // cell_rows) / r.n)
        total = sum(n * share for n, share in large.values())
        large = {key: (n, share * min(1.0, sample / total)) for key, (n, share) in large.items()}
        points: dict[tuple, list] = {}
        for r in at_hand.mapInArrow(draw, "dim long, cell long, data binary").limit(2 * sample).collect() if large else []:
            points.setdefault((r.dim, r.cell), []).append(units(np.frombuffer(r.data, source).astype(np.float64)[None])[1][0])
        if not points:
            break
        more: dict[int, list] = {}
        for (dim, cell), some in sorted(points.items()):
            more.setdefault(dim, []).append(centres_of(np.array(some), max(1, min(len(some) // 4, 2 * -(-large[dim, cell][0] // cell_rows)))))
        plans |= {dim: Parts(np.concatenate([plans[dim].pivots, *some]), reach) for dim, some in more.items()}
        before, at_hand = at_hand, placed(at_hand)
        discard(before)
        measured = measured_cells(at_hand)
    sizes: dict[int, dict[int, tuple]] = {}
    cores = {(r.dim, r.cell): (r.weight, r.head) for r in measured}
    for r in measured:
        sizes.setdefault(r.dim, {})[r.cell] = (r.n, np.frombuffer(r.low) - _LOOSE, np.frombuffer(r.high) + _LOOSE, np.frombuffer(r.bins, np.int64))
    for dim in sizes:
        plans.setdefault(dim, fresh(dim)).cut(sizes[dim], cell_rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, raw, unit, own, near in matrices(batches):
            plan, dim = plans[unit.shape[1]], unit.shape[1]
            part, made = plan.part_of(own, near, ids), []

            def send(p: int, side: int, at: np.ndarray) -> None:
                made.append((dim, p, side, len(at), ids[at].tobytes(), n[at].tobytes(), own[at].tobytes(), near[at].tobytes(), b"".join([raw[k] for k in at.tolist()])))  # noqa: B023

            for p in np.unique(part).tolist():
                send(p, 0, np.flatnonzero(part == p))
            for p, at in plan.visits(plan.distances(unit), own, near, part):
                send(p, 1, at)
            if work:
                work[1].add(sum(r[3] for r in made))
            types = [*[pa.int64()] * 4, *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], ["dim", "part", "side", "rows", "ids", "n", "cell", "r", "data"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each part's rows among themselves and with its visitors: kind 0 (id, how many), kind 1 (edges that join what is linked)."""
        now, mine, own = None, [], None

        def opened(r):
            read = lambda name, kind: np.frombuffer(r[name], kind)
            return read("ids", np.int64), read("n", np.int64), read("cell", np.int64), read("r", np.float64), units(read("data", source).reshape(r["rows"], -1).astype(np.float64))[1]

        def out(parts):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(a), kind, np.int32) for kind, a, _ in parts])), *(pa.array(np.concatenate([p[k] for p in parts])) for k in (1, 2))], ["kind", "a", "b"])

        def begin():
            rows = [np.concatenate(x) for x in zip(*mine, strict=True)]
            order = np.lexsort((rows[0], rows[2]))
            ids, n, cell, r, unit = (x[order] for x in rows)
            core = np.where(r <= plans[now[0]].core, cell, -1)
            cells = np.flatnonzero(np.diff(cell, prepend=-1))
            state = {"ids": ids, "n": n, "core": core, "unit": unit, "rough": unit.astype(np.float32), "cells": cell[cells], "ends": np.append(cells, len(ids)), "count": np.zeros(len(ids), np.int64), "parent": np.arange(len(ids))}
            for lo in range(0, len(ids), 512):
                meet(state, n[lo : lo + 512], cell[lo : lo + 512], r[lo : lo + 512], unit[lo : lo + 512], lo)
            heads = np.array([cores[now[0], c][1] if c >= 0 else -1 for c in core.tolist()], np.int64)
            some = (heads >= 0) & (heads != ids)
            return state, (1, ids[some], heads[some])

        def near_pairs(state, cell, r, unit, at) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pairs (of the given rows, of the part's) that single precision finds near enough."""
            plan = plans[now[0]]
            may = plan.may(plan.distances(unit), cell, r, state["cells"])
            few, ends = unit.astype(np.float32), state["ends"]
            least_ = least - (1e-4 + 4e-7 * unit.shape[1])
            if at is not None:
                may &= ends[1:] > at + np.arange(len(unit))[:, None] + 1
            if may.mean() > 0.5:
                pieces = [(np.arange(len(unit)), 0 if at is None else at, int(ends[-1]))]
            else:
                pieces = [(np.flatnonzero(may[:, k]), int(ends[k]), int(ends[k + 1])) for k in np.flatnonzero(may.any(0)).tolist()]
            for some, lo, hi in pieces:
                if work:
                    work[0].add(len(some) * (hi - lo) if at is None else int(np.maximum(0, hi - np.maximum(lo, at + some + 1)).sum()))
                j, i = np.nonzero(few[some] @ state["rough"][lo:hi].T >= least_)
                yield some[j], i + lo

        def meet(state, n, cell, r, unit, at=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Compare some rows with the part's (at: their place among those); counts of theirs, and for each that is linked one of the part's."""
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *near_pairs(state, cell, r, unit, at)]
            j, i = (np.concatenate(x) for x in zip(*found, strict=True))
            core = np.where(r <= plans[now[0]].core, cell, -1)
            ok = (core[j] < 0) | (core[j] != state["core"][i])
            if at is not None:  # within the part each pair meets once
                ok &= i > j + at
            j, i = j[ok], i[ok]
            ok = np.ones(len(j), bool)
            for a in range(0, len(j), 65536):
                ok[a : a + 65536] = (unit[j[a : a + 65536]] * state["unit"][i[a : a + 65536]]).sum(1) >= least
            j, i = j[ok], i[ok]
            order = np.argsort(j, kind="stable")
            j, i = j[order], i[order]
            theirs = np.bincount(j, state["n"][i], len(n)).astype(np.int64)
            state["count"] += np.bincount(i, n[j], len(state["n"])).astype(np.int64)
            if at is not None:
                state["count"][at : at + len(n)] += theirs
                state["parent"] = unite(state["parent"], j + at, i)
                return theirs, j[:0], i[:0]
            first = np.flatnonzero(np.diff(j, prepend=-1))  # a row's first partner stands for all
            state["parent"] = unite(state["parent"], i, np.repeat(i[first], np.diff(np.append(first, len(j)))))
            return theirs, j[first], i[first]

        def close():
            ids, parent = own["ids"], own["parent"]
            tree = np.flatnonzero(parent != np.arange(len(parent)))
            return out([(0, ids, own["count"]), (1, ids[tree], ids[parent[tree]])])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["dim"], r["part"]) != now:
                    if mine and own is None:
                        own, edges = begin()
                        yield out([edges])
                    if own is not None:
                        yield close()
                    now, mine, own = (r["dim"], r["part"]), [], None
                if r["side"] == 0:
                    mine.append(opened(r))
                    continue
                if not mine:  # a part that no row of its own has come to
                    continue
                if own is None:
                    own, edges = begin()
                    yield out([edges])
                ids, *rest = opened(r)
                for lo in range(0, len(ids), 512):
                    theirs, j, i = meet(own, *(x[lo : lo + 512] for x in rest))
                    if len(j):
                        some = theirs > 0
                        yield out([(0, ids[lo : lo + 512][some], theirs[some]), (1, ids[lo : lo + 512][j], own["ids"][i])])
        if mine and own is None:
            own, edges = begin()
            yield out([edges])
        if own is not None:
            yield close()

    dealt = at_hand.mapInArrow(deal, "dim long, part long, side long, rows long, ids binary, n binary, cell binary, r binary, data binary")
    tasks = max([1, *(min(plan.parts, 100_000) for plan in plans.values())])
    met = dealt.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("dim", "part", "side")
    found = written(met.mapInArrow(link, "kind int, a long, b long"), "links")

    def cored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a core row is linked with in its core."""
        for ids, n, _, unit, own, near in matrices(batches):
            weight = np.array([cores[unit.shape[1], c][0] for c in own.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.where(near <= plans[unit.shape[1]].core, weight - n, 0))], ["id", "inner"])

    counted = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("outer"))
    inner = at_hand.mapInArrow(cored, "id long, inner long")
    roots = connected_components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("id"), "root")
    links = F.col("n") - 1 + F.coalesce("outer", F.lit(0)) + F.col("inner")
    named = single.select("id", "key", "n", "least").join(inner, "id").join(counted, "id", "left").join(roots, "id", "left").select("key", "least", links.cast("long").alias("n_links"), F.coalesce("root", "id").alias("root"))
    named = written(named, "named")
    smallest = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    done = written(named.join(smallest, "root").select("key", "n_links", "component_id"), "by_vector")
    component = F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("vec_id"))
    whole = table.select("vec_id", "key").join(done, "key", "left")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
