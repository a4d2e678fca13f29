from __future__ import annotations

import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioseek.llm import batches, tokens
from folioseek.plans.sizing import work_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=40), st.integers(0, 60))
def test_elias_fano_round_trip(values, shift):
    values = np.sort(np.array([v >> shift for v in values], np.int64))
    raw = tokens.EliasFano.encode(values).to_bytes()
    back, at = tokens.EliasFano.from_bytes(memoryview(b"ab" + raw + b"c"), 2)
    assert at == 2 + len(raw)
    assert back.all().tolist() == values.tolist()
    assert [back.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        back.select(len(values))


def test_many_boundaries_are_small_and_selectable():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20_000))
    coded = tokens.EliasFano.encode(ends)
    assert len(coded.to_bytes()) < 2 * len(ends)  # 8 bytes each as a plain table
    for i in range(0, 20_000, 371):
        assert coded.select(i) == ends[i]


TEXT = st.lists(
    st.sampled_from([" ", "\n", "\t", " ", "　", "\x1c", "a", "Word", "don't", ".", ",", "..", "é", "漢", "_", "'s", "1", "½", "“", "\r", "!"]),
    max_size=14,
).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8))
def test_pieces_give_the_ids_of_whole_texts(texts):
    own = tokens.encoder(PATH)
    found = [ids.tolist() for _, _, d, o in batches.chunks(pa.array(texts, pa.string())) for ids in own.encode(d, o, 2)]
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    assert found == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def plain_rows(rows):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    coded = [(k, np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for k, t in rows]
    start, found = 0, []
    for key, ids in coded:
        found.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return found


@pytest.mark.parametrize("rows", [brute.ODD, [], [(3, None)], [(i, f"doc {i}") for i in range(400)]])
def test_written_and_read_back(spark, rows):
    path = work_path(spark, "tokens")
    tokens.write(brute.frame(spark, rows), path, PATH, 2, 5)
    found = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read(spark, path).collect()]
    assert sorted(found, key=lambda r: r[1]) == plain_rows(rows)


def test_segment_reads_one_document(spark):
    path = work_path(spark, "tokens")
    tokens.write(brute.frame(spark, [(1, "a b"), (2, ""), (5, "c d e")]), path, PATH, 2, 1)
    segment = tokens.Segment.from_bytes(spark.read.parquet(path).first().data)
    assert segment.doc_ids() == [1, 2, 5]
    assert segment.document(1).tolist() == [2]
    assert tokens.encoder(PATH).tokenizer.decode(segment.document(2)[:-1].tolist()) == "c d e"
    with pytest.raises(ValueError):
        tokens.Segment.from_bytes(b"something else")


def test_an_added_token_in_a_text_is_one_id():
    mark = "<|endoftext|>"
    texts = ["a b", f"one {mark} two", mark, f"x{mark}y {mark}", "<|endof", "text|>", None, f"\n{mark}"]
    own = tokens.encoder(PATH)
    found = [ids.tolist() for _, _, d, o in batches.chunks(pa.array(texts, pa.string())) for ids in own.encode(d, o, 2)]
    plain = Tokenizer.from_file(PATH)
    assert found == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert [ids.count(50256) for ids in found] == [0, 1, 1, 2, 0, 0, 0, 1]
