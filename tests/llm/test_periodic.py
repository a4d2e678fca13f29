from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest

import __spark_entry__ as contract
from folioseek.llm import periodic
from folioseek.llm.queries import with_planted_runs


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """Runs by trying all periods: start, length, period."""
    found = []
    for q in range(1, len(w) // periodic.EXPONENT + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(periodic.LEAST, periodic.EXPONENT * q):
                own = w[i : i + length]
                if not any(own[d:] == own[: length - d] for d in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(w: list[str], runs) -> str:
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def planted(key, w: list[str]) -> list[str]:
    h = zlib.crc32(str(key).encode())
    if key is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sequences(seed: int):
    rng = random.Random(seed)
    for _ in range(150):
        w: list[int] = []
        for _ in range(rng.randrange(1, 6)):
            unit = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 9))]
            w += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit))]
            w += [rng.randrange(12) for _ in range(rng.randrange(4))]
        yield w


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_trying_all_periods(seed):
    some = 0
    for w in sequences(seed):
        found = [tuple(r) for r in periodic.runs_of(np.array(w)).tolist()]
        assert found == plain_runs(w)
        some += len(found)
    assert some > 100


@pytest.mark.parametrize("seed", range(3))
def test_extensions_equal_comparing(seed):
    rng = np.random.default_rng(seed)
    w = rng.integers(1, 3, 90).tolist()
    tree = periodic.Extensions(w)
    i, j = (x[~np.eye(91, dtype=bool)] for x in np.meshgrid(np.arange(91), np.arange(91)))
    want = [next((k for k in range(90) if max(a, b) + k >= 90 or w[a + k] != w[b + k]), 90) for a, b in zip(i, j)]
    assert tree.extension(i, j).tolist() == want
    assert np.argsort(tree.rank).tolist() == sorted(range(91), key=lambda k: w[k:])
    assert np.argsort(tree.reversed_rank()).tolist() == sorted(range(91), key=lambda k: [-x for x in w[k:]])


def texts():
    rng = random.Random(5)
    rows = [(k, " ".join(f"w{x}" for x in w)) for k, w in enumerate(sequences(11))]
    words = [f"v{i}" for i in range(300)]
    for k in range(200, 240):
        rows.append((k, "\n ".join(rng.choice(words) for _ in range(rng.randrange(400)))))
    rows.append((500, " ".join(["same"] * 3000 + ["a", "b", "c"] * 2000)))
    return rows


@pytest.mark.parametrize("chunk", [1 << 19, 300])
def test_rows_equal_plain_version(spark, monkeypatch, chunk):
    rows = [*texts(), *brute.ODD]
    plain = [[k, brute.SPACED.findall(t or "")] for k, t in rows]
    want = []
    for k, w in plain:
        runs = plain_runs(w) if len(w) < 20_000 else [(0, 30_000, 997)]  # by the making of the long text
        want.append((k, runs, plain_collapsed(w, runs)))
    assert sum(bool(r) for _, r, _ in want) > 50
    monkeypatch.setattr(periodic.batches, "CHUNK_BYTES", chunk)
    found = periodic.collapse(brute.frame(spark, rows)).collect()
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic.collapse(brute.frame(spark, [])).collect() == []


def test_planted_runs(spark):
    rows = [(k, " ".join(f"w{i % (3 + k % 50)}" for i in range(k % 97))) for k in range(400)] + [(None, "a b"), (400, None)]
    found = with_planted_runs(brute.frame(spark, rows)).collect()
    want = [(k, planted(k, brute.SPACED.findall(t or ""))) for k, t in rows]
    assert sorted(((r.doc_id, brute.SPACED.findall(r.text or "")) for r in found), key=repr) == sorted(want, key=repr)
    assert sum(a[1] != brute.SPACED.findall(b[1] or "") for a, b in zip(want, rows)) > 10


def test_query_equals_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in contract.queries()["op11_periodic_runs"](spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for key, text in docs:
        w = planted(key, brute.SPACED.findall(text or ""))
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        own = found[key]
        assert (own.n_runs, own.start, own.length, own.period) == (len(runs), *best)
        assert own.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert own.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert own.collapsed_sha256 == hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
