from __future__ import annotations

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest

from folioseek.llm import batches, jaccard
from folioseek.llm.bits import bit_map
from folioseek.llm.components import components, merged


def random_rows(seed: int, n: int = 120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 6, 40, 80]))] for _ in range(n // 6)]
    common = [rng.choice(vocabulary) for _ in range(20)]
    rows = []
    for i in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            if own:
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            own += common
        rows.append((i * 3, " ".join(w.upper() if rng.random() < 0.1 else w for w in own)))
    return rows


@pytest.mark.parametrize(("seed", "width", "num", "frequent", "block"), [(1, 4, 85, 32, 2048), (2, 5, 80, 3, 4), (3, 2, 60, 2, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, width, num, frequent, block):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = random_rows(seed)
    found = {r.doc_id: r for r in jaccard.group(brute.frame(spark, rows), width, num, 100).collect()}
    want = brute.components(rows, width, num, 100)
    assert [found[k].component_id for k, _ in rows] == want
    assert [found[k].n_shingles for k, _ in rows] == [len(brute.shingles(t, width)) for _, t in rows]
    assert 1 < len(set(want)) < len(rows)


def test_odd_rows(spark):
    found = jaccard.group(brute.frame(spark, brute.ODD), 4, 85, 100).select("doc_id", "n_shingles", "component_id").collect()
    want = [
        (k, len(brute.shingles(t, 4)), c)
        for (k, t), c in zip(brute.ODD, brute.components(brute.ODD, 4, 85, 100), strict=True)
    ]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert jaccard.group(brute.frame(spark, [])).collect() == []


def test_one_of_each_keeps_whole_rows(spark):
    docs = brute.frame(spark, brute.ODD)
    left = jaccard.one_of_each(docs, 4, 85, 100)
    assert left.columns == docs.columns
    # of LONG and its copy, of 6 and 7, of 8 twice and 9, one each
    kept = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert kept == [1, 2, 3, 4, 6, 8, 10, 11, 12, 2**40]
    assert left.where("doc_id is null").count() == 2
    assert jaccard.one_of_each(brute.frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_trees_find_all_pairs_over_the_bound(seed):
    rng = np.random.default_rng(seed)
    centers = rng.poisson(6, (12, jaccard.COARSE))
    points = np.maximum(0, centers[rng.integers(0, 12, 400)] + rng.integers(-1, 2, (400, jaccard.COARSE)))
    sizes = points.sum(axis=1)
    bound = np.minimum(points[:, None], points[None]).sum(axis=2)
    ok = bound * 185 >= 85 * (sizes[:, None] + sizes[None])
    tree = jaccard.CountTree(points, sizes)
    found = {tuple(sorted(p)) for p in jaccard.surviving(tree, None, 85, 100).tolist()}
    assert found == {(i, j) for i in range(400) for j in range(i + 1, 400) if ok[i, j]}
    a, b = jaccard.CountTree(points[:150], sizes[:150]), jaccard.CountTree(points[150:], sizes[150:])
    found = {(i, j + 150) for i, j in jaccard.surviving(a, b, 85, 100).tolist()}
    assert found == {(i, j) for i in range(150) for j in range(150, 400) if ok[i, j]}


def test_trees_prune():
    rng = np.random.default_rng(9)
    points = rng.poisson(np.repeat(rng.integers(2, 400, 128), 16)[:, None], (2048, jaccard.COARSE))
    tree = jaccard.CountTree(points, points.sum(axis=1))
    tested = 0
    plain = np.minimum

    def counting(a, b):
        nonlocal tested
        tested += len(a) if a.ndim == 2 else 0
        return plain(a, b)

    jaccard.np.minimum, kept = counting, jaccard.np.minimum
    try:
        jaccard.surviving(tree, None, 85, 100)
    finally:
        jaccard.np.minimum = kept
    assert tested < 2048 * 2047 / 2 / 2


def test_cells_may_span_batches():
    text = [" ".join(f"t{(i // 3) * 50 + k}" for k in range(30)) + f" x{i}" for i in range(12)]
    (_, _, data, offsets), = batches.chunks(pa.array(text))
    sets = batches.shingle_sets(data, offsets, 2)
    columns = {
        "shingle": [0] * 12, "block_a": [0] * 12, "block_b": [0] * 12, "block": [0] * 12,
        "key": [jaccard.signature(s) for s in sets], "comp": list(range(12)), "n": [len(s) for s in sets],
        "point": [jaccard.bucket_point(s) for s in sets],
    }
    whole = pa.RecordBatch.from_pydict(columns)

    def pairs(parts):
        return sorted(tuple(p.values()) for b in jaccard._tree_pairs(80, 100)(iter(parts)) for p in b.to_pylist())

    together = pairs([whole])
    assert len(together) >= 12
    assert together == pairs([whole.slice(0, 1), whole.slice(1, 6), whole.slice(7, 5)])


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0}
    assert {found[100 + k] for k in range(30)} == {100}
    assert found[300] == found[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_links(rows, width, num, den):
    """Number of other sets that each row's set links with."""
    sets = [brute.shingles(t, width) for _, t in rows]
    different = {s for s in sets if s}
    return [
        sum(s != o and den * len(s & o) >= num * len(s | o) for o in different) if s else 0
        for s in sets
    ]


@pytest.mark.parametrize("block", [512, 7])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "COUNTED_SETS", block)
    base = [f"b{i}" for i in range(200)]
    near = [(1000 + i, " ".join([*base[: 5 * i], f"new{i}", *base[5 * i + 1 :]])) for i in range(40)]
    rows = [*near, *random_rows(1)]
    found = {r.doc_id: r.n_links for r in jaccard.group(brute.frame(spark, rows), 4, 85, 100).collect()}
    want = plain_links(rows, 4, 85, 100)
    assert min(want[:40]) == 39 and max(want[40:]) > 0
    assert [found[k] for k, _ in rows] == want


def test_label_joins_carry_no_columns_that_are_not_read(spark, monkeypatch):
    stored, store = [], jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: stored.append((name, set(df.columns))) or store(df, name))
    jaccard.links(brute.frame(spark, random_rows(1, 24)), 4, 85, 100)
    assert [c for n, c in stored if n == "inside"] == [{"shingle", "key", "comp"}, {"shingle", "key", "comp", "m", "least", "most"}]


def test_surviving_pairs_take_bounded_memory():
    """Near points prune nothing above the leaves; children of all their nodes at once took 98 MB."""
    rng = np.random.default_rng(5)
    points = rng.integers(0, 2, (4096, jaccard.COARSE), np.int8)
    points[:, 0] += 1
    sizes = points.sum(axis=1)
    tree, other = (jaccard.CountTree(points[i::2].astype(np.int64), sizes[i::2]) for i in range(2))
    shared = np.minimum(points[::2][:, None], points[1::2][None]).sum(axis=2)
    want = np.argwhere(shared * 185 >= 85 * (sizes[::2][:, None] + sizes[1::2][None]))
    tracemalloc.start()
    found = jaccard.surviving(tree, other, 85, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(np.unique(found, axis=0), want)
    assert peak < 48 << 20


def test_merged_components_equal_those_of_all_edges(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)]
    edges = [(a, b) for a, b in edges if a != b]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    for first in (0, 30, len(edges)):
        found = merged(components(frame(edges[:first])), frame(edges[first:]))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, components(frame(edges)).collect()))


def test_only_shared_shingles_are_joined_with_buckets(spark):
    """Prefixes of texts that share nothing are not shuffled a second time."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(200)] + [(900, "a b c d e f g"), (901, "a b c d e f h")]
    described = jaccard.describe(brute.frame(spark, rows), 4, 85, 100)
    ends = described.selectExpr("explode(prefix) as shingle").groupBy("shingle").count().where("count > 1")
    sent = spark.sparkContext.broadcast(bit_map(ends, "shingle", jaccard.MARK_BITS))
    found = jaccard._members(described.where("key is not null"), sent)
    every, shared = described.selectExpr("explode(prefix) as s").count(), ends.count()
    assert every > 1000 and 2 * shared <= found.count() < 2 * shared + 20
    assert found.join(ends, "shingle").count() == 2 * shared


def test_pairs_of_a_cell_come_in_bounded_pieces():
    """Two blocks of near sets, all of whose pairs survive; held all together they took 348 MB."""
    rng = np.random.default_rng(7)
    points = rng.integers(7, 9, (2 * 1536, jaccard.COARSE))
    sizes, n = points.sum(axis=1), len(points)
    cell = pa.RecordBatch.from_pydict({
        "shingle": np.zeros(n, np.int64), "block_a": np.zeros(n, np.int64), "block_b": np.ones(n, np.int64), "block": np.arange(n) % 2,
        "key": np.arange(n), "comp": np.arange(n), "n": sizes, "point": [jaccard.stored_point(p) for p in points],
    })
    shared = np.minimum(points[::2, None], points[None, 1::2]).sum(axis=2)
    want = np.argwhere(shared * 180 >= 80 * (sizes[::2, None] + sizes[None, 1::2]))
    tracemalloc.start()
    found, most = [], 0
    for batch in jaccard._tree_pairs(80, 100)(iter([cell])):
        most = max(most, batch.num_rows)
        found.append(np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(np.int16))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = np.concatenate(found).astype(np.int64)
    odd = pairs % 2
    assert (odd.sum(axis=1) == 1).all() and len(want) > 1 << 20
    sides = np.where(odd[:, :1] == 0, pairs, pairs[:, ::-1]) // 2
    assert np.array_equal(np.unique(sides, axis=0), want)
    assert most <= 2 * jaccard.EXPANDED and peak < 64 << 20
