from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioseek.operators import blocks


def brute(ids, rows, queries, k, metric):
    if metric == "bits":
        differing = [[sum((int(a) ^ int(b)).bit_count() for a, b in zip(r, q)) for r in rows] for q in queries]
        order = [sorted(range(len(ids)), key=lambda i: (d[i], ids[i]))[:k] for d in differing]
        return [(j, int(ids[i])) for j, places in enumerate(order) for i in places]
    rows, queries = blocks.prepared(rows, metric), blocks.prepared(queries, metric)
    found = []
    for j, q in enumerate(queries):
        scores = blocks.pair_scores(rows, np.repeat(q[None, :], len(rows), 0), metric)
        order = np.lexsort((ids, np.where(np.isnan(scores), np.inf, scores)))[:k]
        found += [(j, int(ids[i])) for i in order]
    return found


def answer(ids, rows, queries, k, metric, batch):
    block = blocks.QueryBlock(np.arange(len(queries)), queries, k, metric)
    parts = ((ids[i : i + batch], rows[i : i + batch]) for i in range(0, len(ids), batch))
    query, row, _ = blocks.top_k(parts, block).rows()
    return [(int(q), int(r)) for q, r in zip(query, row)]


@pytest.mark.parametrize("metric", blocks.METRICS)
@given(
    seed=st.integers(0, 10**6), n=st.integers(0, 60), q=st.integers(1, 6), dim=st.integers(1, 9), k=st.integers(1, 12),
    batch=st.integers(1, 70), grid=st.booleans(), scale=st.sampled_from([1e-3, 1.0, 1e5]),
)
@settings(max_examples=40, deadline=None)
def test_equals_brute_force(metric, seed, n, q, dim, k, batch, grid, scale):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, dim))
    queries = rng.standard_normal((q, dim))
    if metric == "bits":
        most = 4 if grid else 2**63
        rows, queries = (rng.integers(0, most, x.shape).astype(np.uint64) for x in (rows, queries))
    elif grid:  # many ties and zero vectors
        rows, queries = np.round(rows), np.round(queries)
    if metric == "spherical":
        rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        queries = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    elif metric != "bits":
        rows, queries = rows * scale, queries * scale
    ids = rng.permutation(n)
    assert answer(ids, rows, queries, k, metric, batch) == brute(ids, rows, queries, k, metric)


def test_copies_are_ranked_by_id():
    rows = np.tile(np.array([[0.1, 0.2, 0.3]]), (1000, 1))
    ids = np.arange(1000)[::-1].copy()
    assert answer(ids, rows, rows[:1] + 1, 3, "l2", 170) == [(0, 0), (0, 1), (0, 2)]


def test_undefined_scores_come_last_and_are_kept():
    rows = np.array([[np.nan, 1.0], [0.0, 0.0], [3.0, 4.0]])
    ids = np.array([1, 2, 3])
    assert answer(ids, rows, np.array([[3.0, 4.0]]), 3, "l2", 3) == [(0, 3), (0, 2), (0, 1)]
    assert answer(ids, rows, np.array([[3.0, 4.0]]), 3, "cosine", 3) == [(0, 3), (0, 1), (0, 2)]


def test_small_steps_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    rows, queries, ids = rng.standard_normal((500, 8)), rng.standard_normal((20, 8)), np.arange(500)
    whole = answer(ids, rows, queries, 7, "l2", 500)
    monkeypatch.setattr(blocks, "CELLS", 50)
    assert answer(ids, rows, queries, 7, "l2", 90) == whole


def test_matrix_rejects_unequal_lengths():
    with pytest.raises(ValueError, match="different vector dimensions"):
        blocks.matrix(pa.array([[1.0, 2.0], [1.0]], pa.list_(pa.float32())))


def test_matrix_of_a_slice():
    whole = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], pa.list_(pa.float32()))
    assert blocks.matrix(whole.slice(1, 2)).tolist() == [[3.0, 4.0], [5.0, 6.0]]


def test_bad_arguments():
    with pytest.raises(ValueError):
        blocks.QueryBlock(np.arange(1), np.ones((1, 2)), 0, "l2")
    with pytest.raises(ValueError):
        blocks.QueryBlock(np.arange(1), np.ones((1, 2)), 1, "nearest")


@pytest.mark.parametrize("metric", blocks.METRICS)
@pytest.mark.parametrize("grid", [False, True])
def test_wide_vectors_in_many_tiles_equal_brute_force(metric, grid, monkeypatch):
    monkeypatch.setattr(blocks, "TILE_ROWS", 64)
    monkeypatch.setattr(blocks, "TILE_QUERIES", 16)
    monkeypatch.setattr(blocks, "STRIP", 24)
    rng = np.random.default_rng(5)
    rows, queries, ids = rng.standard_normal((700, 33)), rng.standard_normal((40, 33)), rng.permutation(700)
    if metric == "bits":
        rows, queries = (rng.integers(0, 8 if grid else 2**63, (n, 2)).astype(np.uint64) for n in (700, 40))
    elif grid:
        rows, queries = np.round(rows / 3), np.round(queries / 3)
    elif metric == "spherical":
        rows, queries = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rows, queries))
    assert answer(ids, rows, queries, 9, metric, 300) == brute(ids, rows, queries, 9, metric)


@pytest.mark.parametrize("metric", ["l2", "l1"])
@pytest.mark.parametrize("scale", [1e-200, 1e-35, 1e6, 1e38])
def test_sizes_of_values_do_not_matter(metric, scale):
    rng = np.random.default_rng(6)
    rows, queries, ids = rng.standard_normal((90, 20)) * scale, rng.standard_normal((5, 20)) * scale, np.arange(90)
    if metric == "l1" or scale > 1e-100:  # squares of the smallest are 0
        assert answer(ids, rows, queries, 4, metric, 50) == brute(ids, rows, queries, 4, metric)


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_far_tiles_are_left_out(metric, monkeypatch):
    rng = np.random.default_rng(7)
    rows = rng.integers(0, 300, (20_000, 2)).astype(float)
    queries = rng.integers(0, 300, (2000, 2)).astype(float)
    ids = np.arange(len(rows))
    want = answer(ids, rows, queries[:50], 5, metric, len(rows))
    scored = []
    rough = blocks._rough
    monkeypatch.setattr(blocks, "_rough", lambda a, b, m: scored.append(len(a) * len(b)) or rough(a, b, m))
    monkeypatch.setattr(blocks, "TILE_ROWS", 256)
    monkeypatch.setattr(blocks, "TILE_QUERIES", 64)
    near, asked = blocks.near_order(rows, 256), blocks.near_order(queries, 64)
    assert sorted(near.tolist()) == list(range(len(rows)))
    block = blocks.QueryBlock(asked, queries[asked], 5, metric)
    query, row, _ = blocks.top_k(iter([(ids[near], rows[near])]), block).rows()
    found = sorted((int(asked[q]), place, int(r)) for place, (q, r) in enumerate(zip(query, row)) if asked[q] < 50)
    assert [(q, r) for q, _, r in found] == want
    assert sum(scored) < len(rows) * len(queries) / 5
