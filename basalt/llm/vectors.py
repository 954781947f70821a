"""What the operators on vectors share: sound rows as matrices, centres of a sample, sets of linked rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BATCH = 4096


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are sound (no null, all components finite), their lengths, and all their components in a row."""
    values = column.flatten()  # of rows that aren't null
    flat = np.asarray(values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)  # null becomes NaN
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = (bad[ends] == bad[ends - sizes]) & ~np.asarray(column.is_null()) & (sizes > 0)
    return ok, sizes, flat


def sound_blocks(batches: Iterator[pa.RecordBatch], column: str = "embedding") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, rows of it, matrix) of like dimension, sound rows only."""
    for batch in batches:
        ok, sizes, flat = rows_of(batch.column(column))
        begins = np.cumsum(sizes) - sizes
        for dim in np.unique(sizes[ok]).tolist():
            at = np.flatnonzero(ok & (sizes == dim))
            for lo in range(0, len(at), _BATCH):
                some = at[lo : lo + _BATCH]
                yield batch, some, flat[begins[some][:, None] + np.arange(dim)]


def units(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows aren't zero, and those scaled to length 1; components may be as large or small as doubles go."""
    most = np.abs(matrix).max(1, initial=0)
    ok = most > 0
    scaled = matrix[ok] / most[ok, None]
    return ok, scaled / np.sqrt((scaled**2).sum(1))[:, None]


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to centres."""
    squares = (x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(0, squares))


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each as far as can be from those before it."""
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 1e-12:
            break
        chosen.append(int(far.argmax()))
    return points[chosen]


def centres_of(points: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """Means of n groups of the points, begun from points that lie far apart."""
    centres = farthest_first(points, n)
    for _ in range(rounds):
        own = distances(points, centres).argmin(1)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of sets named by their smallest member; parent stays flat."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
