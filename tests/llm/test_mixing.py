from __future__ import annotations

import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from folioseek.llm import mixing

WEIGHTS = "domain string, lang string, source string, weight int"


def shares(budget, nodes):
    """Fill siblings (name: (capacity, weight)) by giving the rest out again until none overflows."""
    given = dict.fromkeys(nodes, 0.0)
    free = {k for k, (cap, w) in nodes.items() if cap > 0 and w > 0}
    while budget > 1e-9 and free:
        total = sum(nodes[k][1] for k in free)
        part = {k: budget * nodes[k][1] / total for k in free}
        for k in list(free):
            room = nodes[k][0] - given[k]
            take = min(room, part[k])
            given[k] += take
            budget -= take
            if room <= part[k]:
                free.discard(k)
    return given


def tree_shares(budget, leaves, weights, epochs, depth=0):
    """leaves: {path: tokens}; returns {path: budget} by filling each level in turn."""
    if depth == 3:
        return {next(iter(leaves)): budget}
    groups = {}
    for path, n in leaves.items():
        groups.setdefault(path[: depth + 1], {})[path] = n
    nodes = {k: (sum(g.values()) * epochs, weights.get(k, 1)) for k, g in groups.items()}
    found = {}
    for k, b in shares(budget, nodes).items():
        found |= tree_shares(b, groups[k], weights, epochs, depth + 1)
    return found


@pytest.mark.parametrize("budget", [10, 137, 600, 2000, 10**6])
def test_budgets_equal_repeated_redistribution(spark, budget):
    leaves = {
        ("a", "en", "s0"): 400, ("a", "en", "s1"): 10, ("a", "de", "s0"): 30, ("a", "de", "s2"): 0,
        ("b", "en", "s0"): 50, ("b", "fr", "s3"): 25, ("c", "en", "s9"): 1, ("d", "en", "s9"): 99,
    }
    weights = {("a",): 3, ("b",): 2, ("d",): 0, ("a", "de"): 5, ("b", "fr", "s3"): 7}
    table = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, lang string, source string, tokens long")
    given = spark.createDataFrame([(*k, *[None] * (3 - len(k)), w) for k, w in weights.items()], WEIGHTS)
    found = {tuple(r)[:3]: r.budget for r in mixing.allocate(table, given, F.lit(budget), mixing.PATH, 2).collect()}
    want = tree_shares(budget, leaves, weights, 2)
    assert set(found) == set(leaves)
    assert all(abs(found[k] - want[k]) <= 3 for k in leaves)
    assert found[("d", "en", "s9")] == 0
    assert sum(found.values()) <= budget


def placed(spark, rows):
    return brute.frame(spark, rows).withColumn("domain", F.lit("d").cast("string"))


def no_weights(spark):
    return spark.createDataFrame([], WEIGHTS)


def test_epochs_and_prefixes(spark):
    rows = [(i, " ".join(["w"] * (i % 9 + 1))) for i in range(200)]
    docs = brute.frame(spark, rows).withColumns({"domain": F.lit("d"), "lang": F.lit("en"), "source": F.lit("s")})
    total = sum(i % 9 + 1 for i, _ in rows)
    for budget in (1, 100, total, total + 57, 2 * total + 5, 5 * total):
        found = mixing.mix(docs, no_weights(spark), F.lit(budget), max_epochs=3, seed=5).collect()
        taken = sum(r.take_tokens for r in found)
        assert taken == min(budget, 3 * total)
        last = min(budget, 3 * total) // total + 1
        for epoch in range(1, last):
            assert sorted(r.doc_id for r in found if r.epoch == epoch) == [i for i, _ in rows]
        order = sorted(rows, key=lambda r: hashlib.md5(f"5:{last}:{r[0]}".encode()).hexdigest())
        left, want = min(budget, 3 * total) - (last - 1) * total, []
        for i, _ in order:
            if left <= 0:
                break
            want.append((i, min(left, i % 9 + 1)))
            left -= i % 9 + 1
        assert sorted((r.doc_id, r.take_tokens) for r in found if r.epoch == last) == sorted(want)


def test_odd_rows(spark):
    docs = placed(spark, brute.ODD)
    whole = mixing.mix(docs, no_weights(spark), max_epochs=1)
    assert set(docs.columns) | {"epoch", "n_tokens", "take_tokens"} == set(whole.columns)
    rows = whole.collect()
    with_words = [t for _, t in brute.ODD if brute.words(t)]
    assert sorted(r.text for r in rows if brute.words(r.text)) == sorted(with_words)
    assert sum(r.take_tokens for r in rows) == sum(len(brute.words(t)) for t in with_words)
    half = mixing.mix(docs, no_weights(spark), F.floor(F.sum("tokens") / 2), seed=3).collect()
    assert sum(r.take_tokens for r in half) <= sum(r.take_tokens for r in rows) / 2 + 1
    assert mixing.mix(placed(spark, []), no_weights(spark)).collect() == []
