from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folioseek.llm import batches

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabAB.é漢", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_word_hashes_tell_words_apart(texts, size):
    column = pa.array(texts, pa.string())
    found = []
    for low, high, data, offsets in batches.chunks(column, size):
        hashes, first = batches.word_hashes(data, offsets)
        assert len(first) == high - low + 1
        found += [hashes[first[i] : first[i + 1]].tolist() for i in range(high - low)]
    assert len(found) == len(texts)
    for own, text in zip(found, texts, strict=True):
        assert own == [batches.one_hash(w.encode()) for w in brute.words(text)]


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingle_sets_have_the_size_of_plain_ones(texts, width):
    column = pa.array(texts, pa.string())
    found = [s for _, _, d, o in batches.chunks(column) for s in batches.shingle_sets(d, o, width)]
    plain = [brute.shingles(t, width) for t in texts]
    assert [len(s) for s in found] == [len(s) for s in plain]
    for i in range(len(texts)):
        for j in range(i):
            shared = len(set(found[i].tolist()) & set(found[j].tolist()))
            assert shared == len(plain[i] & plain[j])


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 3))
def test_code_point_runs_stay_inside_their_text(texts, width):
    for _, _, data, offsets in batches.chunks(pa.array(texts, pa.string())):
        points, at = batches.code_points(data, offsets)
        buckets, first = batches.gram_buckets(points, at, width, 12)
        assert len(buckets) == first[-1]
        plain = [max(0, len(t or "") - width + 1) for t in texts]
        assert np.diff(first).tolist() == plain


def test_sliced_columns():
    column = pa.array(["a b", None, "c", "d e f"]).slice(1, 3)
    (_, _, data, offsets), = batches.chunks(column)
    assert data.tobytes() == b"cd e f"
    assert offsets.tolist() == [0, 0, 1, 6]
