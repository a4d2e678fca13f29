"""Periodic runs of words, by suffix trees and constant-time longest common extensions.

A run is a stretch of words that repeats with its smallest period q at least ``EXPONENT`` times,
has at least ``LEAST`` words, and cannot be made longer. By the runs theorem every run holds, under
the order of words or under its reverse, a Lyndon word of length q that is the longest one to
begin at its place. So there are two candidates a place: its longest Lyndon word under either
order, which ends where the next smaller suffix begins. Candidate (i, q) is extended to the right by
the longest common extension of the suffixes i and i + q, and to the left by that of the
reversed document. Both come from Ukkonen's suffix trees: the extension of two suffixes is the depth of
their leaves' lowest common ancestor, which is the least depth in the Euler tour between them.
Minima are answered in constant time from a sparse table over blocks of the tour and running minima
inside the blocks.

Building trees is the slow part, so places that cannot lie in a run are left out before. All
five words in a row inside a run occur again at most a quarter of the run away. Stretches in which
every place passes that test hold all runs whole, and each has trees of its own. The test only
spares work: whatever passes it, the runs come from the trees.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.llm import batches
from folioseek.plans.shipping import ship_package

#: Least words of a run, and least repeats of its period.
LEAST, EXPONENT = 6, 4
#: Words in a row that the test before the trees compares; at most ``LEAST - 1``.
GRAM = 5
#: Times that the test is made; each looks only at the stretches that the one before left.
ROUNDS = 4
#: Places of the tour in a block.
BLOCK = 16


def ukkonen(symbols: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """Suffix tree of symbols, the last of which occurs once: children, begin and end of the edge into each node.

    Node 0 is the root; children are keyed by ``node * size + symbol``; leaves end with the symbols.
    """
    n, size = len(symbols), max(symbols) + 1
    begin, end, link = [0], [0], [0]
    child: dict[int, int] = {}
    node = edge = length = rest = 0
    for i, symbol in enumerate(symbols):
        rest += 1
        last = 0
        while rest:
            if not length:
                edge = i
            key = node * size + symbols[edge]
            down = child.get(key)
            if down is None:
                child[key] = len(begin)
                begin.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                last = 0
            else:
                span = min(end[down], i + 1) - begin[down]
                if length >= span:
                    edge += span
                    length -= span
                    node = down
                    continue
                if symbols[begin[down] + length] == symbol:
                    length += 1
                    if last:
                        link[last] = node
                    break
                middle = len(begin)
                begin += (begin[down], i)
                end += (begin[down] + length, n)
                link += (0, 0)
                child[key] = middle
                child[middle * size + symbol] = middle + 1
                begin[down] += length
                child[middle * size + symbols[begin[down]]] = down
                if last:
                    link[last] = middle
                last = middle
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return child, begin, end, size


class Extensions:
    """Longest common extensions of the suffixes of a sequence of symbols above 0."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        child, begin, end, size = ukkonen([*symbols, 0])
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.children = np.fromiter(child.values(), np.int64, len(child))[order]
        self.first = np.searchsorted(keys[order] // size, np.arange(len(begin) + 1))
        self.edge = np.array(end) - np.array(begin)
        self._tour()
        self._blocks()

    def _tour(self) -> None:
        """Depths along the Euler tour, the place of each suffix's leaf in it, and the order of the leaves."""
        children, first, edge = self.children.tolist(), self.first.tolist(), self.edge.tolist()
        depths, place, leaves = [0], [0] * (self.n + 1), []
        nodes, depth, nexts = [0], [0], [first[0]]
        while nodes:
            node, at = nodes[-1], nexts[-1]
            if at == first[node + 1]:
                nodes.pop()
                depth.pop()
                nexts.pop()
                if depth:
                    depths.append(depth[-1])
                continue
            nexts[-1] += 1
            down = children[at]
            below = depth[-1] + edge[down]
            if first[down] == first[down + 1]:
                suffix = self.n + 1 - below
                place[suffix] = len(depths)
                leaves.append(suffix)
                depths += (below, depth[-1])
            else:
                depths.append(below)
                nodes.append(down)
                depth.append(below)
                nexts.append(first[down])
        self.depths, self.place = np.array(depths, np.int32), np.array(place)
        self.rank = np.empty(self.n + 1, np.int64)
        self.rank[leaves] = np.arange(self.n + 1)

    def _blocks(self) -> None:
        pad = -len(self.depths) % BLOCK
        rows = np.concatenate([self.depths, np.full(pad, np.iinfo(np.int32).max, np.int32)]).reshape(-1, BLOCK)
        self.from_left = np.minimum.accumulate(rows, axis=1).ravel()
        self.from_right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.rows = rows
        self.sparse = [rows.min(axis=1)]
        while 2 << (len(self.sparse) - 1) <= len(rows):
            top, step = self.sparse[-1], 1 << (len(self.sparse) - 1)
            self.sparse.append(np.minimum(top[:-step], top[step:]))

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that different suffixes ``i`` and ``j`` (the empty one is ``n``) have in common at their beginnings."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        x, y = a // BLOCK, b // BLOCK
        least = np.minimum(self.from_right[a], self.from_left[b])
        same = np.flatnonzero(x == y)
        if len(same):
            column = np.arange(BLOCK)
            inside = (column >= (a[same] % BLOCK)[:, None]) & (column <= (b[same] % BLOCK)[:, None])
            least[same] = np.where(inside, self.rows[x[same]], np.iinfo(np.int32).max).min(axis=1)
        between = np.maximum(y - x - 1, 0)
        level = np.frexp(np.maximum(between, 1))[1] - 1
        for k in np.unique(level[between > 0]).tolist():
            at = np.flatnonzero((between > 0) & (level == k))
            top = self.sparse[k]
            least[at] = np.minimum(least[at], np.minimum(top[x[at] + 1], top[y[at] - (1 << k)]))
        return least.astype(np.int64)

    def reversed_rank(self) -> np.ndarray:
        """Rank of every suffix when words are ordered the other way round, a prefix still before what it begins."""
        children, first, edge = self.children.tolist(), self.first.tolist(), self.edge.tolist()
        rank, nodes, seen = [0] * (self.n + 1), [(0, 0)], 0
        while nodes:
            node, depth = nodes.pop()
            low, high = first[node], first[node + 1]
            if low == high:
                rank[self.n + 1 - depth] = seen
                seen += 1
                continue
            below = [(down, depth + edge[down]) for down in children[low:high]]
            ending = children[low]
            if edge[ending] == 1 and first[ending] == first[ending + 1]:  # the end symbol alone: the first of all
                below.append(below.pop(0))
            nodes += below
        return np.array(rank)


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """End of the longest Lyndon word that begins at each place: where the next smaller suffix begins."""
    order = rank.tolist()
    n = len(order) - 1
    ends, stack = [0] * n, [n]
    for i in range(n - 1, -1, -1):
        own = order[i]
        while order[stack[-1]] > own:
            stack.pop()
        ends[i] = stack[-1]
        stack.append(i)
    return np.array(ends, np.int64)


def runs_of(symbols: np.ndarray) -> np.ndarray:
    """All runs of a sequence, as rows ``start, length, period`` sorted by start, then period."""
    n = len(symbols)
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    known = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    forward, backward = Extensions(known), Extensions(known[::-1])
    starts = np.arange(n)
    ends = [lyndon_ends(rank) for rank in (forward.rank, forward.reversed_rank())]
    candidates = np.unique(np.concatenate([np.stack([starts, end - starts], axis=1) for end in ends]), axis=0)
    i, q = candidates[candidates[:, 1] * EXPONENT <= n].T
    right = forward.extension(i, i + q)
    left = backward.extension(n - i, n - i - q)
    found = np.stack([i - left, q + left + right, q], axis=1)
    found = found[found[:, 1] >= np.maximum(LEAST, EXPONENT * q)]
    return np.unique(found, axis=0) if len(found) else found


def stretches(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of the stretches of words outside of which there is no run; none crosses texts."""
    count = max(0, len(words) - GRAM + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[:count] == text[GRAM - 1 :] if count else np.zeros(0, bool)
    grams = batches.run_hashes(words, GRAM) ^ batches.mixed(text[:count].astype(np.uint64) + np.uint64(1))
    open_ = np.flatnonzero(inside)
    grams = grams[open_]
    for _ in range(ROUNDS):
        if not len(open_):
            break
        # a stretch is a text's consecutive places; only repeats inside one count
        new = (np.diff(open_) != 1) | (np.diff(text[open_]) != 0)
        stretch = np.concatenate([[0], np.cumsum(new)])
        longest = (np.bincount(stretch)[stretch] + GRAM - 1) // EXPONENT
        order = np.lexsort((open_, grams, stretch))
        equal = (np.diff(grams[order]) == 0) & (np.diff(stretch[order]) == 0)
        gap = np.where(equal, np.diff(open_[order]), np.iinfo(np.int64).max)
        nearest = np.empty(len(open_), np.int64)
        nearest[order] = np.minimum(np.append(gap, np.iinfo(np.int64).max), np.insert(gap, 0, np.iinfo(np.int64).max))
        kept = nearest <= longest
        open_, grams = open_[kept], grams[kept]
        if kept.all():
            break
    if not len(open_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((np.diff(open_) != 1) | (np.diff(text[open_]) != 0))
    return open_[np.concatenate([[0], cut + 1])], open_[np.append(cut, len(open_) - 1)] + GRAM


def runs_in(data: np.ndarray, offsets: np.ndarray):
    """Runs of all texts of a chunk: text, start in it, length, period; and the bytes, ends and texts of the words."""
    joined, begin, end, first = batches.joined_words(data, offsets)
    words = batches.span_hashes(joined, begin, end, batches.EXACT) if len(begin) else np.zeros(0, np.uint64)
    found = [np.zeros((0, 4), np.int64)]
    for low, high in zip(*(x.tolist() for x in stretches(words, first)), strict=True):
        own = runs_of(words[low:high])
        if len(own):
            text = int(np.searchsorted(first, low, "right")) - 1
            own[:, 0] += low - first[text]
            found.append(np.insert(own, 0, text, axis=1))
    return np.concatenate(found), joined, begin, end, first


def _without_repeats(runs: np.ndarray, joined, begin, end, first) -> list[bytes]:
    """Words of each text joined by single spaces, without those that some run contains after its first period."""
    edges = np.zeros(len(begin) + 1, np.int64)
    if len(runs):
        at = first[runs[:, 0]] + runs[:, 1]
        np.add.at(edges, at + runs[:, 3], 1)
        np.add.at(edges, at + runs[:, 2], -1)
    kept = np.cumsum(edges[:-1]) == 0
    left = joined[np.repeat(kept, end - begin + 1)]
    upto = np.concatenate([[0], np.cumsum((end - begin + 1) * kept)])[first]
    return [left[a : b - 1].tobytes() if b > a else b"" for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def collapse(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): doc_id, runs (start, length, period), collapsed.

    Words are what ASCII white space leaves; ``runs`` are sorted by start, then period, and count words
    from 0. ``collapsed`` holds the words joined by single spaces, each run cut down to its first period.
    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Ids may be null
    or repeated; every row is judged by its own text. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for low, high, data, offsets in batches.chunks(batch.column(1)):
                found, *words = runs_in(data, offsets)
                upto = np.searchsorted(found[:, 0], np.arange(high - low + 1))
                each = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.ListArray.from_arrays(pa.array(upto, pa.int32()), each),
                        pa.array(_without_repeats(found, *words), pa.binary()),
                    ],
                    ["doc_id", "runs", "collapsed"],
                )

    ddl = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, ddl)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
