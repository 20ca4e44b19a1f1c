"""Scores of a block of queries against batches of rows, with the k best of each query kept on the way."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.types import DataType
from pyspark.sql.pandas.types import to_arrow_type

#: So many numbers are held in one matrix of scores.
CELLS = 4_000_000


def best_columns(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, ties by the smaller column."""
    n = s.shape[1]
    if k >= n:
        return np.argsort(-s, axis=1, kind="stable")
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(s, near, 1)
    edge = value.min(axis=1)
    tied = np.flatnonzero((s >= edge[:, None]).sum(axis=1) > k)  # which of the equal ones were taken is left to chance there
    near.sort(axis=1)
    o = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
    near = np.take_along_axis(near, o, 1)
    if len(tied):
        near[tied] = np.argsort(-np.where(s[tied] >= edge[tied, None], s[tied], -np.inf), axis=1, kind="stable")[:, :k]
    return near


def kth_at_least(s: np.ndarray, k: int) -> np.ndarray:
    """A value that at least k columns of each row reach: the k-th of the maxima of groups of columns; the k-th of all where there are few."""
    groups = max(4 * k, 128)
    width = s.shape[1] // groups
    best = s[:, : width * groups].reshape(len(s), width, groups).max(axis=1) if width > 1 else s
    return -np.partition(-best, k - 1, axis=1)[:, k - 1]


def key_array(column: pa.Array) -> np.ndarray:
    """Keys as an array that sorts as they do."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    values = column.to_pylist()
    return np.array(values, str) if values and pa.types.is_string(column.type) else np.array(values, object)


class Best:
    """The k best rows of each query so far, by score descending and key ascending; -inf is no row."""

    def __init__(self, k: int):
        self.k = k
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # first query -> (keys, scores)

    def least(self, first: int, rows: int) -> np.ndarray:
        """The score that a row must reach to be kept, for the queries from ``first`` on."""
        if first in self.blocks and self.blocks[first][1].shape[1] >= self.k:
            return self.blocks[first][1].min(axis=1)
        return np.full(rows, -np.inf)

    def add_sparse(self, first: int, rows: int, line: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        """Rows as (query, key, score), queries in order."""
        counts = np.bincount(line, minlength=rows)
        if len(line):
            at = np.arange(len(line)) - (np.cumsum(counts) - counts)[line]
            wide, value = np.zeros((rows, counts.max()), keys.dtype), np.full((rows, counts.max()), -np.inf)
            wide[line, at], value[line, at] = keys, scores
            self.add(first, wide, value)

    def add_matrix(self, first: int, keys: np.ndarray, s: np.ndarray, places: int) -> None:
        """The scores of all rows, in the order of their keys, which count rounded to ``places`` and if above 0; after the first rows few reach what is kept, and only those are rounded and looked at."""
        edge = self.least(first, len(s))
        if s.shape[1] > self.k and not np.isfinite(edge).all():
            edge = np.maximum(edge, kth_at_least(s, self.k))
        line, at = np.divmod(np.flatnonzero(s >= np.maximum(edge - 2 * 10.0**-places, 0.1 * 10.0**-places)[:, None]), s.shape[1])
        scores = np.round(s[line, at], places)
        good = scores > 0
        self.add_sparse(first, len(s), line[good], keys[at[good]], scores[good])

    def add(self, first: int, keys: np.ndarray, scores: np.ndarray) -> None:
        """Rows found for the queries from ``first`` on, a line for each."""
        if first in self.blocks:
            old = self.blocks[first]
            keys, scores = np.concatenate([old[0], keys], 1), np.concatenate([old[1], scores], 1)
        if scores.shape[1] > self.k:
            # what is below the k-th best cannot stay; of what may, keys decide among equal scores
            edge = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            most = int((scores >= edge).sum(axis=1).max())
            o = np.argsort(-scores, axis=1, kind="stable")[:, : max(self.k, min(most, scores.shape[1]))]
            keys, scores = np.take_along_axis(keys, o, 1), np.take_along_axis(scores, o, 1)
            o = np.argsort(keys, axis=1, kind="stable")
            keys, scores = np.take_along_axis(keys, o, 1), np.take_along_axis(scores, o, 1)
            o = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
            keys, scores = np.take_along_axis(keys, o, 1), np.take_along_axis(scores, o, 1)
        self.blocks[first] = (keys, scores)

    def batches(self, ids: pa.Array, key_type: DataType, names: list[str], rows: int = 100_000):
        """(query, key, score) record batches of all that was kept."""
        kind = to_arrow_type(key_type)
        for first, (keys, scores) in sorted(self.blocks.items()):
            line, at = np.nonzero(np.isfinite(scores))
            for i in range(0, len(line), rows):
                a, b = line[i : i + rows], at[i : i + rows]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + a)), pa.array(keys[a, b].tolist(), kind), pa.array(scores[a, b].astype(np.float64))], names)
