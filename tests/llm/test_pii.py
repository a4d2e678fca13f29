from __future__ import annotations

import hashlib
import re
import time

import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folioseek.llm import pii

#: The agreed patterns as they are written.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+".replace(r"[\x20-]", "[ -]"))
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return found


PARTS = st.sampled_from(
    ["a@b.c", "x.y@", "@", ".", "..", "1", "255", "256", "12.0.3.4", "4111111111111111", "4111 1111 1111 1111", "-", " ",
     "+49 30 1234567", "+1", "(", ")", "é", " ", "\n", "0000000000000000", "00255.1.1.1", "%", "word", "a-b.co.uk"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    ((own, words),) = pii.marked_words(pa.array([text]))
    assert own == text
    assert pii.joined(pii.base_spans(text, words)) == pii.joined(plain(text))


def test_odd_rows(spark):
    docs = brute.frame(spark, brute.ODD)
    rows = pii.annotate(docs, pii.train(docs)).collect()
    assert len(rows) == len(brute.ODD)
    for r in rows:
        base = plain(r.text or "")
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        spans = r.spans.split(",") if r.spans else []
        assert set(pii.joined(base).split(",")) - {""} <= set(spans)
        assert len(spans) == len(base) + r.n_added


def test_empty_table(spark):
    docs = brute.frame(spark, [])
    assert pii.annotate(docs, pii.train(docs)).collect() == []


def test_long_runs_take_linear_time():
    texts = pa.array(["9" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+1 " * 60_000, "%+-" * 70_000 + "@"])
    started = time.perf_counter()
    pii.find(texts, pii.Field(np.zeros((pii.WIDTH, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 0.0))
    assert time.perf_counter() - started < 20


def exact(g, field):
    """Marginals by summing over all labellings."""
    n, labels = len(g.features), pii.LABELS
    total = np.zeros((n, labels))
    for code in np.ndindex(*[labels] * n):
        score = sum((g.features[i] @ field.unary)[code[i]] for i in range(n))
        score += sum(field.chain[code[a], code[b]] for a, b in g.chain)
        score += sum(field.skip * (code[a] == code[b]) for a, b in g.skip)
        for i in range(n):
            total[i, code[i]] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_give_exact_marginals_on_a_tree():
    rng = np.random.default_rng(2)
    features = (rng.random((5, pii.WIDTH)) < 0.3).astype(np.float32)
    g = pii.Graph(features, np.array([[0, 1], [3, 4]]), np.array([[1, 3]]))
    field = pii.Field(rng.normal(size=(pii.WIDTH, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), 0.8)
    pii_rounds = pii.ROUNDS
    try:
        pii.ROUNDS = 60
        assert np.allclose(pii.marginals(g, field), exact(g, field), atol=1e-4)
    finally:
        pii.ROUNDS = pii_rounds


def test_skip_edges_carry_a_label_to_a_repeated_word():
    g = pii.graph([("call 5551234567 now then 5551234567", [(5, 15), (25, 35)])])
    assert g.skip.tolist() == [[0, 1]]
    features = np.zeros((2, pii.WIDTH), np.float32)
    features[0, 0] = features[1, 1] = 1
    unary = np.zeros((pii.WIDTH, pii.LABELS))
    unary[0, 4] = 4.0
    alone, linked = (
        pii.marginals(pii.Graph(features, np.zeros((0, 2), int), g.skip), pii.Field(unary, np.zeros((5, 5)), s)) for s in (0.0, 3.0)
    )
    assert linked[1, 4] > 0.6 > alone[1, 4]


def test_messages_reach_every_repeat_of_a_word():
    """Along a chain of skip edges the marginals are those of a Markov chain."""
    n, strength = 30, 6.0
    features = np.zeros((n, pii.WIDTH), np.float32)
    features[0, 0] = 1
    unary = np.zeros((pii.WIDTH, pii.LABELS))
    unary[0, 4] = 8.0
    g = pii.Graph(features, np.zeros((0, 2), int), np.array([[i, i + 1] for i in range(n - 1)]))
    step = np.exp(np.eye(pii.LABELS) * strength)
    want = [np.exp(unary[0])]
    for _ in range(n - 1):
        want.append(want[-1] @ step)
    want = np.array([w / w.sum() for w in want])
    assert want[20, 4] > 0.7
    found = pii.marginals(g, pii.Field(unary, np.zeros((5, 5)), strength))
    assert np.allclose(found, want, atol=1e-4)
