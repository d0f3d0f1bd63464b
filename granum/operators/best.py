"""The best rows of each query that one task has met, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and rows that are scored together, and results of the queries that one task may hold.
QUERIES, ROWS, HELD = 256, 4096, 1 << 20
#: Points of a row that a query does not meet, and points of a score of one.
UNMET, UNIT = np.iinfo(np.int64).min, 1_000_000


def points(score: np.ndarray) -> np.ndarray:
    """Scores as whole millionths, half up; what is not finite is not met."""
    fine = np.isfinite(score)
    return np.where(fine, np.floor(np.where(fine, score, 0.0) * UNIT + 0.5).astype(np.int64), UNMET)


class Best:
    """The ``k`` best of all rows added for each query, by points and then by smaller id; no more are held."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.held: dict[int, tuple[np.ndarray, np.ndarray, pa.Array]] = {}
        self.bars: dict[int, np.ndarray] = {}

    def add(self, first: int, got: np.ndarray, ids: pa.Array) -> None:
        """Rows ``ids``, ascending and ``ROWS`` at most, with their points ``got[query - first, row]``."""
        n, width = got.shape
        bar = self.bars.get(first, np.full(n, UNMET))
        fits = (got != UNMET) & (got >= bar[:, None])
        if width > self.k and np.count_nonzero(fits) > 2 * n * self.k:
            key = np.where(fits, got * ROWS + (ROWS - 1 - np.arange(width)), UNMET)  # equal points: the smaller id
            fits &= key >= np.partition(key, width - self.k, axis=1)[:, width - self.k][:, None]
        q, at = np.nonzero(fits)
        self._take(first, n, q, got[q, at], ids.take(pa.array(at)))

    def add_scores(self, first: int, score: np.ndarray, ids: pa.Array) -> None:
        """The same from scores; points are made only of those that may be among the best, once there are ``k`` of each query."""
        n = len(score)
        bar = self.bars.get(first)
        near = None
        if bar is not None and (bar != UNMET).all():
            with np.errstate(invalid="ignore"):
                near = score >= ((bar - 1) / UNIT)[:, None]
        if near is None or np.count_nonzero(near) > 2 * n * self.k:
            self.add(first, points(score), ids)
            return
        q, at = np.nonzero(near)
        got = points(score[q, at])
        fits = got >= bar[q]
        self._take(first, n, q[fits], got[fits], ids.take(pa.array(at[fits])))

    def _take(self, first: int, n: int, q: np.ndarray, score: np.ndarray, names: pa.Array) -> None:
        if not len(q):
            return
        if first in self.held:
            old_q, old_score, old_names = self.held[first]
            q, score, names = np.concatenate((old_q, q)), np.concatenate((old_score, score)), pa.concat_arrays([old_names, names])
        place = np.empty(len(names), dtype=np.int64)
        place[pc.array_sort_indices(names, null_placement="at_start").to_numpy()] = np.arange(len(names))
        order = np.lexsort((place, -score, q))
        rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        keep = order[rank < self.k]
        self.held[first] = q[keep], score[keep], names.take(pa.array(keep))
        bar = np.full(n, UNMET)
        kth = order[rank == self.k - 1]
        bar[q[kth]] = score[kth]
        self.bars[first] = bar

    def rows(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """Numbers of queries, ids and scores."""
        for first, (q, score, names) in self.held.items():
            yield first + q, names, score / UNIT
