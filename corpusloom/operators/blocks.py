"""Products of blocks of vectors inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

NEAR_SCHEMA = "query_id string, id string, distance double"


def unit(rows) -> np.ndarray:
    return normal(np.array([np.asarray(r, dtype=np.float64) for r in rows]))


def normal(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def unit_column(column: pa.Array) -> np.ndarray:
    """The unit vectors of a column of lists, without an object for each."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != sizes[:1]).any():
        raise ValueError("vectors of several dimensions")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return normal(values.reshape(len(sizes), -1))


#: Rows that meet the queries at a time; pairs, and numbers of their vectors, that are compared in double precision at a time.
SLICE, PAIRS, NUMBERS = 1024, 65_536, 1 << 20


class Best:
    """The k rows of each query that are least far, ties by id.

    Rows wait, and are sorted when as many wait as are kept, so a task sorts about as often
    as its rows double. ``last`` is how far each query's k-th row was when rows were last
    sorted: rows farther than that needn't be added.
    """

    def __init__(self, queries: int, k: int) -> None:
        self.queries, self.k = queries, k
        self.last = np.full(queries, np.inf)
        self.kept = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, object))
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def add(self, query: np.ndarray, far: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
        if len(query):
            self.waiting.append((query, far, value, ids))
            if sum(len(w[0]) for w in self.waiting) >= self.k * self.queries:
                self._sort()

    def _sort(self) -> None:
        query, far, value, ids = (np.concatenate(x) for x in zip(self.kept, *self.waiting, strict=True))
        self.waiting = []
        order = np.lexsort((far, query))
        same = (np.diff(query[order]) == 0) & (np.diff(far[order]) == 0)
        tied = np.append(same, False) | np.insert(same, 0, False)
        ties = order[tied]
        order[tied] = ties[np.lexsort((ids[ties].astype(str), far[ties], query[ties]))]
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, place = order[place < self.k], place[place < self.k]
        self.kept = tuple(x[order] for x in (query, far, value, ids))
        last = place == self.k - 1
        self.last[self.kept[0][last]] = self.kept[1][last]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and values of the rows that are kept."""
        if self.waiting:
            self._sort()
        query, _, value, ids = self.kept
        return query, ids, value


class Nearest:
    """The k nearest of the rows that some queries have met, ties by id; rows that can't be among them cost a product in single precision only.

    A query's bar is the similarity of its k-th row, less what single precision may be
    wrong by: rows above it are compared in double precision, all others are left alone.
    """

    def __init__(self, names: np.ndarray, matrix: np.ndarray, k: int, exclude_self: bool, least: float | None) -> None:
        self.names, self.matrix, self.rough = names, matrix, matrix.astype(np.float32)
        self.k, self.exclude_self, self.least = k, exclude_self, least
        self.margin = np.float32(2e-7 * (matrix.shape[1] + 16))
        self.floor = np.float32(-np.inf if least is None else least) - self.margin
        self.best = Best(len(names), k)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(ids), SLICE):
            self._meet(ids[at : at + SLICE], vectors[at : at + SLICE])

    def _meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        rough = self.rough @ vectors.astype(np.float32).T
        most = self.k + self.exclude_self
        if np.isinf(self.best.last).all() and most < rough.shape[1]:
            known = np.where(np.isnan(rough), np.float32(-np.inf), rough)
            bar = np.maximum(self.floor, np.partition(known, -most, axis=1)[:, -most] - 2 * self.margin)
        else:
            bar = np.maximum(self.floor, (1 - self.best.last).astype(np.float32) - self.margin)
        query, row = np.divmod(np.flatnonzero(rough >= bar[:, None]), rough.shape[1])
        few = max(1, min(PAIRS, NUMBERS // max(1, vectors.shape[1])))
        for at in range(0, len(query), few):
            self._compare(query[at : at + few], row[at : at + few], ids, vectors)

    def _compare(self, query: np.ndarray, row: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        similar = np.einsum("ij,ij->i", self.matrix[query], vectors[row])
        real = np.isfinite(similar)
        if self.least is not None:
            real &= similar > self.least
        if self.exclude_self:
            real &= self.names[query] != ids[row]
        self.best.add(query[real], np.round(1 - similar[real], 9), similar[real], ids[row[real]])

    def columns(self) -> list[np.ndarray]:
        """Queries, ids and distances of the rows that are kept."""
        query, ids, similar = self.best.rows()
        return [self.names[query], ids, np.maximum(1 - similar, 0)]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("query_id", "id", "distance"), self.columns(), strict=True)))
