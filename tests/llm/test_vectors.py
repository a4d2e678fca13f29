from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from folioseek.llm import vectors

SHAPE = "vec_id bigint, embedding array<{}>, label int, n_links string, h1 string, cid string"


def frame(spark, rows, kind="float"):
    """vec_id, embedding, label, with columns whose names the operator uses."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SHAPE.format(kind))


def fits(row):
    key, v, label = row
    return None not in (key, v, label) and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, least=0.98):
    """Links by comparing all pairs: per row its id, links, component, whether it stays."""
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    unit = [None if not fits(r) else np.array(r[1]) / np.linalg.norm(r[1]) for r in rows]
    for i, j in combinations(range(len(rows)), 2):
        if unit[i] is None or unit[j] is None or rows[i][2] != rows[j][2] or len(unit[i]) != len(unit[j]):
            continue
        if float(unit[i] @ unit[j]) >= least:
            links[i] += 1
            links[j] += 1
            up[top(i)] = top(j)
    found: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            found[top(i)] = min(r[0], found.get(top(i), r[0]))
    ids = [None if r[0] is None else found[top(i)] for i, r in enumerate(rows)]
    return [(r[0], n, c, c == r[0]) for r, n, c in zip(rows, links, ids)]


def near(rng, dim, cosine):
    """A unit vector and another at a cosine from it."""
    a, b = rng.standard_normal((2, dim))
    a /= np.linalg.norm(a)
    b -= (a @ b) * a
    b /= np.linalg.norm(b)
    return a, cosine * a + math.sqrt(1 - cosine**2) * b


def clustered(seed, n=260, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        a, b = near(rng, dim, rng.uniform(0.99, 0.9999) if k % 3 else 0.97)
        rows += [(4 * k, a.tolist(), k % 3), (4 * k + 1, b.tolist(), k % 3)]
        if k % 5 == 0:
            rows += [(4 * k + 2, (2 * a).tolist(), k % 3), (4 * k + 3, a.tolist(), (k + 1) % 3)]
    return rows


@pytest.mark.parametrize(("seed", "block", "small"), [(1, 1024, 48), (2, 5, 3)])
def test_rows_equal_all_pairs(spark, monkeypatch, seed, block, small):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "SMALL", small)
    rows = clustered(seed)
    # a hot group of near copies and a hot vector
    rng = np.random.default_rng(seed)
    center = rng.standard_normal(24)
    rows += [(5000 + k, (center + 0.05 * rng.standard_normal(24)).tolist(), 0) for k in range(60)]
    rows += [(6000 + k, center.tolist(), 0) for k in range(40)]
    found = sorted(map(tuple, vectors.near_copies(frame(spark, rows, "double")).collect()))
    want = sorted(plain(rows))
    assert [r[0] for r in found] == [r[0] for r in want]
    assert all(a[1] <= b[1] for a, b in zip(found, want))
    assert sum(a[1] for a in found) >= 0.99 * sum(b[1] for b in want)
    assert np.mean([a[2:] == b[2:] for a, b in zip(found, want)]) > 0.99


@pytest.mark.parametrize("cosine", [0.9801, 0.985])
def test_recall_at_the_threshold(cosine):
    rng = np.random.default_rng(8)
    pairs = [near(rng, 64, cosine) for _ in range(3000)]
    a, b = (vectors.unit(np.array(x)) for x in zip(*pairs))
    labels = np.zeros(3000, np.int64)
    assert (vectors.buckets(a, labels) == vectors.buckets(b, labels)).any(axis=1).mean() > 0.97


def test_buckets_do_not_hang_on_the_batch():
    rows = vectors.unit(np.random.default_rng(2).standard_normal((500, 64)))
    labels = np.arange(500) % 7
    whole = vectors.buckets(rows, labels)
    for part in np.array_split(np.arange(500), 77):
        assert (vectors.buckets(rows[part], labels[part]) == whole[part]).all()


def test_odd_rows(spark):
    x = [0.25, 0.5, 1.0]
    rows = [
        (None, x, 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [0.25, None, 1.0], 1), (5, [0.25, float("nan"), 1.0], 1),
        (6, [float("inf"), 0.5, 1.0], 1), (7, x, None), (8, x, None), (9, x, 1), (9, x, 1), (10, x, 1), (11, x, 2), (12, [0.5, 1.0], 1),
        (13, [0.5, 1.0, 2.0], 1), (14, [-0.25, -0.5, -1.0], 1), (15, [1e-30, 2e-30, 4e-30], 1), (16, [1e30, 2e30, 4e30], 1),
        (9, [1.0, 0.0, 0.0], 1), (17, [1.0, 0.01, 0.0], 1), (18, [0.25, 0.5, 1.0, 0.0], 1),
    ]
    found = sorted(map(tuple, vectors.near_copies(frame(spark, rows, "double")).collect()), key=repr)
    want = [(k, n, c, True if k is None else kept) for k, n, c, kept in plain(rows)]
    assert found == sorted(want, key=repr)
    assert vectors.near_copies(frame(spark, [])).collect() == []


def test_unusable_vectors():
    column = pa.array([[1.0, 2.0], None, [], [0.0], [1.0, None], [float("nan")], [3.0]], pa.list_(pa.float32())).slice(0, 7)
    assert vectors.usable(column)[1].tolist() == [True, False, False, False, False, False, True]
    assert vectors.usable(column.slice(4, 3))[0][2].tolist() == [3.0]
