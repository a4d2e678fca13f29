from __future__ import annotations

import hashlib

import brute
import pyarrow as pa

from folioseek.llm import fingerprint


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    texts = [t or "" for _, t in order]
    found = []
    for i, (key, _) in enumerate(order):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = fingerprint.digests(pa.array([text, new, after]))
        near = fingerprint.likeness([a, a], [b, c]).tolist()
        found.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, *near))
    return found


def test_odd_rows(spark):
    rows = fingerprint.compare_with_next(brute.frame(spark, brute.ODD), 5).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, plain(brute.ODD)))


def test_many_partitions_and_one_document(spark):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(0, 300, 3)]
    found = fingerprint.compare_with_next(brute.frame(spark, rows), 16).collect()
    assert sorted(map(tuple, found)) == sorted(plain(rows))
    (alone,) = fingerprint.compare_with_next(brute.frame(spark, [(7, "alone it stands")]), 3).collect()
    assert (alone.near_next, alone.doc_id) == (1.0, 7)
    assert fingerprint.compare_with_next(brute.frame(spark, []), 3).collect() == []


def test_likeness_falls_with_edits():
    base = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    texts = [base, base.replace("word1", "wort1"), base[: len(base) // 2] + "q" * 1500, "something else entirely " * 80]
    marks = fingerprint.digests(pa.array(texts))
    near = [float(fingerprint.likeness(marks[:1], [m])[0]) for m in marks]
    assert near[0] == 1 and near[0] > near[1] > near[2]
    assert near[3] <= near[2]
    assert all(0 <= n <= 1 for n in near)


def test_digest_does_not_depend_on_the_batch():
    texts = [t for _, t in brute.ODD]
    assert fingerprint.digests(pa.array(texts)) == [fingerprint.digests(pa.array([t], pa.string()))[0] for t in texts]
