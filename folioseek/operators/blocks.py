"""Exact top-k over blocks of vectors.

Each task multiplies its Arrow batches with a bounded block of queries and keeps the best
``k`` rows per query, so at most ``tasks * queries * k`` rows are shuffled and no
query-times-row product is ever emitted. Matrix products only narrow the field: rows within a
rounding margin of the k-th are scored again element by element, which makes scores and ties
independent of how rows fall into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

METRICS = ("l2", "l1", "cosine", "inner", "spherical", "hamming", "bits")
CELLS = 2_000_000
MARGIN = 1e-9
CROWDED = 4
#: Rows and queries whose scores are computed at once, so that they stay in a core's cache.
TILE_ROWS, TILE_QUERIES, STRIP = 1024, 1024, 64
#: Width from which products are made in single precision; narrower ones cost little and gain from the smaller bound.
SINGLE = 16


@dataclass(frozen=True)
class QueryBlock:
    """Query vectors held by every task; ``vectors`` is one row per id."""

    ids: np.ndarray
    vectors: np.ndarray
    k: int
    metric: str

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}; one of {', '.join(METRICS)}")
        if self.k < 1:
            raise ValueError("k must be positive")


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as one row per vector in double; unequal lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    width = dim if dim is not None else (int(lengths[0]) if len(lengths) else 0)
    if (lengths != width).any():
        other = int(lengths[lengths != width][0])
        raise ValueError(f"different vector dimensions {width} and {other}")
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), width)


def words(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A column of packed bits as one row of 64-bit words per vector; unequal lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    width = width if width is not None else (int(lengths[0]) if len(lengths) else 0)
    if (lengths != width).any():
        raise ValueError(f"different numbers of words {width} and {int(lengths[lengths != width][0])}")
    return column.flatten().to_numpy(zero_copy_only=False).astype("int64").view("uint64").reshape(len(column), width)


def rows_of(column: pa.Array, metric: str, width: int | None = None) -> np.ndarray:
    """Rows of a list column as the metric takes them: words of packed bits for ``bits``, else doubles."""
    return words(column, width) if metric == "bits" else matrix(column, width)


def prepared(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in the space where the metric is computed."""
    if metric == "hamming":
        return np.where(vectors > 0, 1.0, -1.0)
    return vectors


def pair_scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Score of row ``i`` of ``a`` against row ``i`` of ``b``, smallest is nearest."""
    if metric == "l2":
        return np.sqrt(((a - b) ** 2).sum(axis=1))
    if metric == "l1":
        return np.abs(a - b).sum(axis=1)
    dot = (a * b).sum(axis=1)
    if metric == "inner":
        return 0.0 - dot
    if metric == "hamming":
        return (a.shape[1] - dot) / 2
    if metric == "spherical":
        return np.arccos(np.clip(dot, -1.0, 1.0)) / np.pi
    size = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1.0 - np.clip(dot / size, -1.0, 1.0)


def _rough(rows: np.ndarray, queries: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """A monotone stand-in for the score (rows by queries), its error bound per query, and whether it may hold NaN.

    Wide vectors are multiplied in single precision, with a bound to match. NaN where the score is undefined.
    """
    if metric == "bits":
        scores = np.zeros((len(rows), len(queries)), np.uint16 if rows.shape[1] < 1024 else np.uint32)
        for i in range(rows.shape[1]):
            scores += np.bitwise_count(rows[:, i][:, None] ^ queries[:, i][None, :])
        return scores, np.zeros(len(queries)), False
    row_sq = (rows * rows).sum(axis=1)
    query_sq = (queries * queries).sum(axis=1)
    if metric == "l1":
        return _rough_l1(rows, queries, bool(np.isfinite(row_sq).all() and np.isfinite(query_sq).all()))
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            rows, queries = rows / np.sqrt(row_sq)[:, None], queries / np.sqrt(query_sq)[:, None]
        row_sq, query_sq = (rows * rows).sum(axis=1), (queries * queries).sum(axis=1)
    width = rows.shape[1]
    clean = bool(np.isfinite(row_sq).all() and np.isfinite(query_sq).all())
    single = clean and width >= SINGLE and max(row_sq.max(initial=0.0), query_sq.max(initial=0.0)) < 1e30
    kind, unit = (np.float32, (width + 8) * 2.0**-23) if single else (np.float64, MARGIN)
    with np.errstate(invalid="ignore", over="ignore"):
        if metric == "l2":
            left = np.concatenate([rows * -2.0, row_sq[:, None], np.ones((len(rows), 1))], axis=1).astype(kind)
            right = np.concatenate([queries, np.ones((len(queries), 1)), query_sq[:, None]], axis=1).astype(kind)
            return left @ right.T, unit * 2 * (_largest(row_sq) + query_sq), not clean
        least = 1e-12 if metric == "spherical" else 1e-300 if kind is np.float64 else 1e-30
        bound = unit * np.sqrt(_largest(row_sq) * query_sq) + least
        return (-rows).astype(kind) @ queries.astype(kind).T, bound, not clean


def _rough_l1(rows: np.ndarray, queries: np.ndarray, clean: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sums of absolute differences, in 16-bit whole numbers where the values allow it.

    ``|a - b|`` is ``2 max(a, b) - a - b``, and each rounded value is off by half a step at most.
    """
    width = rows.shape[1]
    top, most = 16000 // max(1, width), max(np.abs(rows).max(initial=0.0), np.abs(queries).max(initial=0.0))
    if not clean or top < 16 or not 1e-30 < most < 1e30:
        scores = np.empty((len(rows), len(queries)))
        for j, q in enumerate(queries):
            scores[:, j] = np.abs(rows - q).sum(axis=1)
        return scores, MARGIN * (1.0 + np.array([_largest(column) for column in scores.T])), not clean
    scale = top / most
    left, right = (np.rint(part * scale).astype(np.int16) for part in (rows, queries))
    down, across = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    less, fewer = left.sum(axis=1, dtype=np.int16), right.sum(axis=1, dtype=np.int16)
    scores = np.empty((len(rows), len(queries)), np.float32)
    for low in range(0, len(rows), STRIP):
        high = min(low + STRIP, len(rows))
        larger = np.zeros((high - low, len(queries)), np.int16)
        held = np.empty_like(larger)
        for i in range(width):
            np.maximum(down[i, low:high, None], across[i][None, :], out=held)
            np.add(larger, held, out=larger)
        part = scores[low:high]
        np.subtract(larger, 0.5 * less[low:high, None].astype(np.float32), out=part)
        part -= 0.5 * fewer.astype(np.float32)
        part *= np.float32(2.0 / scale)
    return scores, np.full(len(queries), (width + 1) * 1.01 / scale), False


def _exact_rough(scores: np.ndarray, metric: str, width: int) -> np.ndarray:
    """Exact scores in the measure of ``_rough``."""
    if metric == "l2":
        return scores * scores
    if metric == "cosine":
        return scores - 1.0
    if metric == "spherical":
        return -np.cos(scores * np.pi)
    return 2.0 * scores - width if metric == "hamming" else scores


def _largest(values: np.ndarray) -> float:
    """The largest finite value; rows that are not finite need no margin."""
    return float(values[np.isfinite(values)].max(initial=0.0))


class Best:
    """The ``k`` nearest rows seen so far for every query, ties by row id; NaN counts as farthest."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), np.inf)
        self.rough = np.full((queries, k), np.inf)
        self.row_id = np.full((queries, k), -1, dtype="int64")
        self.count = np.zeros(queries, dtype="int64")
        self.worst = np.full(queries, np.inf)

    def ceiling(self, which: np.ndarray) -> np.ndarray:
        """Rough score beyond which a row cannot enter, infinite until ``k`` rows are held."""
        return self.worst[which]

    def merge(self, query: np.ndarray, score: np.ndarray, rough: np.ndarray, row_id: np.ndarray) -> None:
        touched = np.unique(query)
        held_query = np.repeat(touched, self.k)
        real = (np.arange(self.k)[None, :] < self.count[touched][:, None]).ravel()
        query = np.concatenate([held_query[real], query])
        score = np.concatenate([self.score[touched].ravel()[real], score])
        rough = np.concatenate([self.rough[touched].ravel()[real], rough])
        row_id = np.concatenate([self.row_id[touched].ravel()[real], row_id])
        order = np.lexsort((row_id, np.where(np.isnan(score), np.inf, score), query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        keep = place < self.k
        at, order = (query[keep], place[keep]), order[keep]
        self.score[at], self.rough[at], self.row_id[at] = score[order], rough[order], row_id[order]
        self.count[touched] = np.searchsorted(at[0], touched, "right") - np.searchsorted(at[0], touched, "left")
        self.worst[touched] = np.where(self.count[touched] == self.k, self.rough[touched].max(axis=1), np.inf)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(np.arange(self.k)[None, :] < self.count[:, None])
        return query, self.row_id[query, place], self.score[query, place]


def lowest_copies(rows: np.ndarray, row_ids: np.ndarray, k: int) -> np.ndarray:
    """Marks the ``k`` lowest ids of each group of equal rows; no other copy can be among the best."""
    rows = rows if rows.dtype == np.uint64 else rows + 0.0  # -0.0 is 0.0
    keys = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel()
    _, group = np.unique(keys, return_inverse=True)
    order = np.lexsort((row_ids, group))
    place = np.arange(len(rows)) - np.searchsorted(group[order], group[order], side="left")
    wanted = np.zeros(len(rows), dtype=bool)
    wanted[order[place < k]] = True
    return wanted


def near_order(vectors: np.ndarray, leaf: int) -> np.ndarray:
    """An order in which rows near each other stand together: halved by the widest coordinate down to ``leaf`` rows."""
    order, open_parts = np.arange(len(vectors)), [(0, len(vectors))]
    while open_parts:
        low, high = open_parts.pop()
        if high - low <= leaf:
            continue
        part = vectors[order[low:high]]
        with np.errstate(invalid="ignore"):
            spread = part.max(axis=0) - part.min(axis=0)
        if not spread.size or not np.nanmax(np.where(np.isnan(spread), 0.0, spread)) > 0:
            continue
        middle = -(-(high - low) // (2 * leaf)) * leaf
        order[low:high] = order[low:high][np.argpartition(part[:, int(np.nanargmax(spread))], min(middle, high - low - 1))]
        open_parts += [(low, low + middle), (low + middle, high)]
    return order


def _gaps(boxes: tuple[np.ndarray, np.ndarray], queries: np.ndarray, metric: str) -> np.ndarray:
    """Least rough score that a row of each box can have for any of the queries."""
    with np.errstate(invalid="ignore", over="ignore"):
        apart = np.maximum(np.maximum(boxes[0] - queries.max(axis=0), queries.min(axis=0) - boxes[1]), 0.0)
        least = (apart * apart).sum(axis=1) if metric == "l2" else apart.sum(axis=1)
    return np.where(np.isfinite(least), least, -np.inf)


def offer(
    best: Best, rows: np.ndarray, row_ids: np.ndarray, queries: np.ndarray, metric: str, which: np.ndarray | None = None
) -> None:
    """Give ``best`` every (query, row) that may enter it, scored exactly.

    ``queries`` are those numbered ``which`` in ``best`` (all of them by default); both sides
    are already prepared for the metric. Tiles of rows whose box is farther from a group of queries than what
    all of these hold are left out, nearest tiles first; that pays where near rows stand together.
    """
    if not len(rows):
        return
    which = np.arange(len(queries)) if which is None else np.asarray(which)
    cuts = list(range(0, len(rows), TILE_ROWS))
    boxed = metric in ("l2", "l1")
    boxes = (np.minimum.reduceat(rows, cuts, axis=0), np.maximum.reduceat(rows, cuts, axis=0)) if boxed else None
    for first in range(0, len(queries), TILE_QUERIES):
        group, own = queries[first : first + TILE_QUERIES], which[first : first + TILE_QUERIES]
        gaps = _gaps(boxes, group, metric) if boxed else np.full(len(cuts), -np.inf)
        for tile in np.argsort(gaps, kind="stable").tolist():
            if gaps[tile] * (1 - MARGIN) > best.ceiling(own).max():
                break
            part = slice(cuts[tile], cuts[tile] + TILE_ROWS)
            _offer(best, rows[part], row_ids[part], group, metric, own)


def _offer(best: Best, rows, row_ids, queries, metric, which) -> None:
    rough, bound, undefined = _rough(rows, queries, metric)
    if undefined:
        rough[np.isnan(rough)] = np.inf  # ranked last, not lost
        bound[np.isnan(bound)] = np.inf
    held = best.ceiling(which)
    cut = held + bound
    if len(rows) > best.k and not np.isfinite(held).all():
        cut = np.minimum(cut, np.partition(rough, best.k - 1, axis=0)[best.k - 1] + 2 * bound)
    if metric == "spherical":  # all products past 1 or -1 score alike
        cut = np.where(cut >= 1.0 - bound, np.inf, np.maximum(cut, bound - 1.0))
    if rough.dtype.kind == "u":
        cut = np.minimum(cut, np.iinfo(rough.dtype).max).astype(rough.dtype)
    elif rough.dtype == np.float32:
        cut = np.nextafter(cut.astype(np.float32), np.float32(np.inf))
    at, query = np.divmod(np.flatnonzero(rough <= cut[None, :]), len(queries))
    if len(at) > CROWDED * best.k * len(queries):
        wanted = lowest_copies(rows, row_ids, best.k)[at]
        at, query = at[wanted], query[wanted]
    if len(at) == 0:
        return
    if metric == "bits":  # whole numbers: the rough score is exact
        scores = rough[at, query].astype(np.float64)
    else:
        scores = np.empty(len(at))
        step = max(1, CELLS // max(1, rows.shape[1]))
        for i in range(0, len(at), step):
            part = slice(i, i + step)
            scores[part] = pair_scores(rows[at[part]], queries[query[part]], metric)
    exact = _exact_rough(scores, metric, rows.shape[1])
    best.merge(which[query], scores, np.where(np.isnan(exact), np.inf, exact), row_ids[at])


def top_k(batches: Iterator[tuple[np.ndarray, np.ndarray]], block: QueryBlock) -> Best:
    """Best rows per query over ``(ids, vectors)`` batches."""
    queries = prepared(block.vectors, block.metric)
    best = Best(len(queries), block.k)
    if len(queries) == 0:
        return best
    for ids, vectors in batches:
        offer(best, prepared(vectors, block.metric), ids, queries, block.metric)
    return best


def result_batch(best: Best, block: QueryBlock) -> pa.RecordBatch:
    query, row_id, score = best.rows()
    return pa.RecordBatch.from_arrays(
        [pa.array(block.ids[query], pa.int64()), pa.array(row_id, pa.int64()), pa.array(score, pa.float64())],
        names=["query_id", "id", "score"],
    )


RESULT_SCHEMA = "query_id long, id long, score double"
