"""The arithmetic of three operators spelled out in plain Python."""

from __future__ import annotations

import math
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from folioseek.llm import batches, fingerprint, langid, quality

MASK = (1 << 64) - 1
TEXTS = [t for _, t in brute.ODD] + ["a a a b", "ab ab\nab", "éé é", "x", "the end. the end! THE END", "word " * 300 + "日本語 日本語"]


def mixed(h: int) -> int:
    h ^= h >> 32
    h = h * batches.MIX & MASK
    return h ^ (h >> 29)


def word_hash(word: str) -> int:
    total = 0
    for i, b in enumerate(word.encode()):
        total = (total + int(batches.EXACT[b]) * pow(batches.BASE, i, 1 << 64)) & MASK
    return mixed(total)


def gram(points: list[int], bits: int) -> int:
    h = len(points)
    for p in points:
        h = (h * batches.BASE + p) & MASK
    return mixed(h) >> (64 - bits)


def quality_features(text: str | None, bits: int) -> Counter:
    found: Counter = Counter()
    words = brute.SPACED.findall(text or "")
    for i, w in enumerate(words):
        found[word_hash(w) >> (64 - bits)] += 1
        found[int(i > 0 and words[i - 1] == w)] += 1
    for width in quality.WIDTHS:
        points = [ord(c) for c in text or ""]
        for i in range(len(points) - width + 1):
            found[gram(points[i : i + width], bits)] += 1
    return found


def test_quality_counts_and_scores():
    texts = [t if t is None or len(t) < 60_000 else t[:5000] for t in TEXTS]
    bits = 12
    counted = quality.counts_of(pa.array(texts, pa.string()), bits).to_pylist()
    model = quality.QualityModel(np.random.default_rng(2).normal(0, 3, 1 << bits), 0.3, bits)
    scores = quality.scores(pa.array(texts, pa.string()), model)
    for text, raw, score in zip(texts, counted, scores, strict=True):
        want = quality_features(text, bits)
        bucket, n = np.frombuffer(raw, np.int32).reshape(2, -1)
        assert dict(zip(bucket.tolist(), n.tolist())) == dict(want)
        margin = sum(model.margins[b] * k for b, k in want.items()) / max(1, sum(want.values())) + model.bias
        assert score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)


def language_features(text: str) -> Counter:
    """Runs of 1 to 3 characters of the text with one blank for each stretch without letters."""
    kept: list[str] = []
    for i, c in enumerate(text):
        if c.isalpha():
            kept.append(c)
        elif i == 0 or text[i - 1].isalpha():
            kept.append(" ")
    found: Counter = Counter()
    for width in langid.WIDTHS:
        for i in range(len(kept) - width + 1):
            found[gram([ord(c) for c in kept[i : i + width]], langid.BITS)] += 1
    return found


def test_language_vectors_and_predictions():
    texts = [t for t in TEXTS if t and len(t) < 5000]
    rng = np.random.default_rng(4)
    idf = rng.uniform(1, 5, 1 << langid.BITS)
    model = langid.LanguageModel(("a", "b", "c"), idf, rng.normal(0, 1, (1 << langid.BITS, 3)), np.array([0.1, 0.0, -0.1]), 0.7)
    names, scores = langid.predict(pa.array(texts), model)
    for (bucket, count, letter), text, name, score in zip(langid._vectors(pa.array(texts)), texts, names, scores, strict=True):
        want = language_features(text)
        assert dict(zip(bucket.tolist(), count.tolist())) == dict(want)
        assert letter == any(c.isalpha() for c in text)
        if not letter:
            assert (name, score) == ("und", 1.0)
            continue
        value = {b: n * idf[b] for b, n in want.items()}
        size = math.sqrt(sum(v * v for v in value.values()))
        logits = [(sum(v / size * model.weights[b][k] for b, v in value.items()) + model.bias[k]) / 0.7 for k in range(3)]
        p = [math.exp(x - max(logits)) for x in logits]
        assert name == "abc"[int(np.argmax(p))] and score == pytest.approx(max(p) / sum(p), abs=1e-5)


def test_one_pass_of_the_regularised_leader(monkeypatch):
    monkeypatch.setattr(langid, "BITS", 6)
    monkeypatch.setattr(langid, "EPOCHS", 1)
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(64, 5, replace=False)), rng.uniform(0, 1, 5)) for _ in range(40)]
    truth = rng.integers(0, 3, 40)
    weights, bias = langid.fit(rows, truth, 3, seed=9)
    z, n = [[0.0] * 3 for _ in range(65)], [[0.0] * 3 for _ in range(65)]

    def weight(b, k):
        if abs(z[b][k]) <= langid.L1:
            return 0.0
        return -(z[b][k] - math.copysign(langid.L1, z[b][k])) / ((langid.BETA + math.sqrt(n[b][k])) / langid.ALPHA + langid.L2)

    for i in np.random.default_rng(9).permutation(40):
        own = [*zip(rows[i][0].tolist(), rows[i][1].tolist()), (64, 1.0)]
        w = {b: [weight(b, k) for k in range(3)] for b, _ in own}
        logits = [sum(x * w[b][k] for b, x in own) for k in range(3)]
        p = [math.exp(v) / sum(map(math.exp, logits)) for v in logits]
        for b, x in own:
            for k in range(3):
                g = x * (p[k] - (k == truth[i]))
                step = (math.sqrt(n[b][k] + g * g) - math.sqrt(n[b][k])) / langid.ALPHA
                z[b][k] += g - step * w[b][k]
                n[b][k] += g * g
    assert np.allclose(weights, [[weight(b, k) for k in range(3)] for b in range(64)])
    assert np.allclose(bias, [weight(64, k) for k in range(3)])


def plain_digest(text: str | None) -> str:
    data = (text or "").encode()
    counts = [0] * fingerprint.BUCKETS
    for k, (a, b, c) in enumerate(fingerprint.TRIPLETS):
        t1, t2, t3 = fingerprint._tables[3 * k : 3 * k + 3].tolist()
        for i in range(len(data) - c):
            counts[t1[data[i + a]] ^ t2[data[i + b]] ^ t3[data[i + c]]] += 1
    ranked = sorted(counts)
    q = [ranked[fingerprint.BUCKETS * j // 4 - 1] for j in (1, 2, 3)]
    codes = [sum(n > x for x in q) for n in counts]
    packed = [codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, len(codes), 4)]
    length = min(255, round(math.log1p(len(data)) / math.log(fingerprint.LENGTH_STEP)))
    ratios = (q[0] * 15 // max(q[2], 1)) << 4 | (q[1] * 15 // max(q[2], 1))
    return bytes([length, ratios, *packed]).hex()


def plain_likeness(a: str, b: str) -> float:
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    difference = fingerprint.LENGTH_WEIGHT * abs(x[0] - y[0])
    difference += fingerprint.RATIO_WEIGHT * (abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15)))
    for u, v in zip(x[2:], y[2:]):
        for shift in (0, 2, 4, 6):
            step = abs((u >> shift & 3) - (v >> shift & 3))
            difference += 6 if step == 3 else step
    return 1 - min(difference, fingerprint.UNLIKE) / fingerprint.UNLIKE


def test_digests_and_their_likeness():
    texts = [t if t is None else t[:3000] for t in TEXTS]
    digests = fingerprint.digests(pa.array(texts, pa.string()))
    assert digests == [plain_digest(t) for t in texts]
    pairs = [(a, b) for a in digests for b in digests]
    found = fingerprint.likeness([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(found, [plain_likeness(a, b) for a, b in pairs])
