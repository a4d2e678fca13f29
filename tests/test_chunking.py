from __future__ import annotations

import re

import pyarrow as pa
import pytest
from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st

from folioseek.operators import chunking
from folioseek.operators.chunking import closing_sentences, split_text, split_windows

WORDS = st.lists(
    st.sampled_from(["a", "bb", "ccc.", "dd!", "word", "longer?", "é", "😀", "x" * 30, "\n", "\n\n", "  ", "\t"]),
    max_size=60,
).map(" ".join)


def bare(text: str) -> str:
    return re.sub(r"\s", "", text)


@given(text=WORDS, size=st.integers(1, 40), overlap=st.integers(0, 20))
@settings(max_examples=300, deadline=None)
def test_chunks_fit_and_are_not_blank(text, size, overlap):
    chunks = split_text(text, size, min(overlap, size - 1))
    assert all(0 < len(c) <= size for c in chunks)
    assert all(c.strip() for c in chunks)


@given(text=WORDS, size=st.integers(1, 40))
@settings(max_examples=300, deadline=None)
def test_without_overlap_chunks_cover_the_text_once(text, size):
    assert bare("".join(split_text(text, size, 0))) == bare(text)


TOKENS = st.lists(st.tuples(st.sampled_from(["", ".", "!"]), st.sampled_from([" ", "\n", "\n\n", "  "])), max_size=60)


@given(tokens=TOKENS, size=st.integers(6, 60), overlap=st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_chunks_are_runs_that_overlap_by_whole_sentences(tokens, size, overlap):
    # Words differ, so each names its place in the text.
    text = "".join(f"w{i}{end}{gap}" for i, (end, gap) in enumerate(tokens))
    overlap = min(overlap, size - 1)
    place = {f"w{i}{end}": i for i, (end, _) in enumerate(tokens)}
    expected, before = 0, None
    for chunk in split_text(text, size, overlap):
        at = [place[word] for word in chunk.split()]
        assert at == list(range(at[0], at[-1] + 1))
        assert at[0] <= expected <= at[-1]
        if at[0] < expected:
            lead = chunk.split()[: expected - at[0]]
            assert lead == closing_sentences(before, overlap).split()
        expected, before = at[-1] + 1, chunk
    assert expected == len(tokens)


def brute_closing(text: str, limit: int) -> str:
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text) if p]
    fitting = [" ".join(parts[i:]) for i in range(len(parts) + 1)]
    return max((f for f in fitting if len(f) <= limit), key=len)


@given(text=WORDS, limit=st.integers(0, 50))
@settings(max_examples=200, deadline=None)
def test_closing_sentences(text, limit):
    assert closing_sentences(text, limit) == brute_closing(text, limit)


def test_boundaries_are_tried_largest_first():
    text = "One two. Three four.\n\nFive six."
    assert split_text(text, 100, 0) == ["One two. Three four.\n\nFive six."]
    assert split_text(text, 22, 0) == ["One two. Three four.", "Five six."]
    assert split_text(text, 12, 0) == ["One two.", "Three four.", "Five six."]
    assert split_text(text, 6, 0) == ["One", "two.", "Three", "four.", "Five", "six."]
    assert split_text("abcdefg", 3, 0) == ["abc", "def", "g"]


def test_overlap_repeats_closing_sentences():
    text = "Aa bb. Cc dd. Ee ff. Gg hh."
    assert split_text(text, 20, 8) == ["Aa bb. Cc dd. Ee ff.", "Ee ff. Gg hh."]
    assert split_text(text, 14, 8) == ["Aa bb. Cc dd.", "Cc dd. Ee ff.", "Ee ff. Gg hh."]


@pytest.mark.parametrize("length", [0, 1, 999, 1000, 1001, 1800, 1801, 3000])
def test_plain_lengths(length):
    chunks = split_text("x" * length)
    assert "".join(chunks) == "x" * length
    assert len(chunks) == -(-length // 1000)


def test_blank_text_has_no_chunks():
    assert split_text(" \n\n \t ") == []


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(0, ""), (1, "x" * 999), (2, "y" * 1000), (3, "z" * 1001), (4, "ab" * 900), (5, "abc" * 1001)]
    rows += [(6, "😀é" * 1300), (7, "line\nbreak\r\n" * 300), (8, None), (9, "w" * 1200), (10, "w" * 1201)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("size,overlap", [(1000, 200), (1000, 0), (10, 9), (7, 3), (1, 0), (300, 200)])
def test_native_windows_equal_the_plain_rule(texts, size, overlap):
    small = texts.filter("doc_id <> 6") if size < 100 else texts
    expected = [
        (r["doc_id"], i, w) for r in small.collect() for i, w in enumerate(split_windows(r["text"] or "", size, overlap))
    ]
    assert values(chunking.window_chunks(small, size, overlap)) == sorted(expected, key=repr)


def test_window_arguments(texts):
    with pytest.raises(ValueError):
        chunking.window_chunks(texts, 10, 10)


def test_chunk_documents_isolates_failures_and_carries_columns(spark):
    def fussy(text):
        if "bad" in text:
            raise ValueError("no bad words")
        return text.split()

    docs = spark.createDataFrame(
        [(1, "a b", "m1"), (2, "bad c", "m2"), (3, "", "m3"), (4, None, "m4")], "doc_id long, text string, m string"
    )
    rows = chunking.chunk_documents(docs, fussy, carry=("m",)).collect()
    assert sorted((r["doc_id"], r["m"], r["chunk_index"], r["content"], r["error"]) for r in rows if r["error"] is None) == [
        (1, "m1", 0, "a", None), (1, "m1", 1, "b", None)
    ]
    assert [(r["doc_id"], r["error"]) for r in rows if r["error"]] == [(2, "no bad words")]


def test_long_documents_leave_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(chunking, "FLUSH_CHARS", 10)
    docs = spark.createDataFrame([(1, "abcd " * 50), (2, "efgh " * 3)], "doc_id long, text string")
    got = chunking.chunk_documents(docs, str.split)
    assert got.groupBy("doc_id").count().collect()[0]["count"] in (50, 3)
    assert values(got.filter("doc_id = 1"), "chunk_index") == sorted([(i,) for i in range(50)], key=repr)


def test_runs_of_blanks_take_linear_time():
    import time

    blank = (" " * 500 + "\n") * 2000
    started = time.perf_counter()
    assert chunking.split_text("a" + " " * 1_000_000 + "b" + blank + "c") == ["a b", "a b\n\nc"]
    assert time.perf_counter() - started < 1


def test_a_long_text_is_not_held_once_per_chunk(spark, monkeypatch):
    class Caught:
        schema = spark.createDataFrame([], "doc_id long, metadata string, text string").schema

        def mapInArrow(self, job, schema):
            return job

    monkeypatch.setattr(chunking.sizing, "fill_cores", lambda df, *keys: Caught())
    docs = spark.createDataFrame([], Caught.schema)
    job = chunking.chunk_documents(docs, split_windows, carry=("metadata",))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "metadata": ["m"], "text": ["x" * 800_000]})
    pool = pa.default_memory_pool()
    peak, held = pool.max_memory(), pool.bytes_allocated()
    assert sum(b.num_rows for b in job(iter([batch]))) == 1000
    assert pool.max_memory() <= max(peak, held + 50_000_000)  # 800 MB before
