from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioseek.llm import importance


@pytest.mark.parametrize("slice_bytes", [1 << 18, 100])
def test_crcs_equal_the_library(monkeypatch, slice_bytes):
    monkeypatch.setattr(importance, "SLICE", slice_bytes)
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 40_000).astype(np.uint8)
    begin = rng.integers(0, 30_000, 500)
    end = begin + rng.choice([1, 2, 7, 63, 64, 65, 128, 129, 255, 256, 257, 700], 500)
    begin, end = np.append(begin, [0, 5]), np.append(end, [40_000, 33_333])
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(begin, end)]
    assert importance.span_crcs(data, begin, end).tolist() == want
    assert importance.span_crcs(data, begin[:0], end[:0]).tolist() == []


def features(text):
    w = brute.WORD.findall((text or "").translate(brute.UPPER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % 10_000


def plain(rows, target, seed, num, den):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            counts.update(map(bucket, features(text)[1]))
    whole_s, whole_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (whole_s + 10_000) / ((s[b] + 1) * (whole_t + 10_000))))

    scored = []
    for key, text in rows:
        w, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    fit = sorted((r for r in scored if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for place, row in enumerate(fit):
        row[4] = place + 1 if place < num * len(fit) // den else None
    return [tuple(r) if any(r is f for f in fit) else (*r[:4], None) for r in scored]


def test_rows_equal_plain_version(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi"
    rows = [*brute.ODD, *[(100 + k, f"{base} word{k % 7} Benchmark text {k % 3} " * (1 + k % 4)) for k in range(60)]]
    rows += [(200, rows[-1][1])] * 3 + [(None, base + " twice")] * 2
    target = ["Benchmark text 2", None, "", "word3 word3 word3, theta iota"]
    items = spark.createDataFrame([(x,) for x in target], "text string")
    found = importance.resample(brute.frame(spark, rows), items, seed=7, num=50, den=100)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    # equal rows share their places in any order
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain(rows, target, 7, 50, 100), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(brute.frame(spark, []), none, 7, 25, 100).collect() == []
    rows = [(k, brute.LONG[: 200 + k]) for k in range(8)]
    found = importance.resample(brute.frame(spark, rows), none, 7, 25, 100).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(plain(rows, [], 7, 25, 100), key=repr)
    assert sorted(r.rank for r in found if r.rank) == [1, 2]


def test_places_cross_ranges(spark):
    df = spark.range(1000).selectExpr("id % 10 as x", "id as _row")
    placed = importance.places(df, F.col("x").desc(), F.col("_row").asc()).collect()
    want = sorted(((k % 10, k) for k in range(1000)), key=lambda r: (-r[0], r[1]))
    assert [(r.x, r._row) for r in sorted(placed, key=lambda r: r._place)] == want
    assert sorted(r._place for r in placed) == list(range(1, 1001))
