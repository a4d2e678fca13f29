from __future__ import annotations

import tracemalloc

import brute
import numpy as np
import pyarrow as pa

from folioseek.llm import quality, queries

EMPTY = "doc_id bigint, quality int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op1_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = rows.where("held_out").join(labels, "doc_id").collect()
    assert len(judged) > 50
    assert np.mean([r.predicted == r.quality for r in judged]) >= 0.95
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert rows.where("score < 0 or score > 1 or score is null").count() == 0


def test_odd_rows_are_scored(spark):
    docs = brute.frame(spark, brute.ODD)
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (8, 1), (8, 0), (10, 0), (None, 1), (11, None)], EMPTY)
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(brute.ODD)
    assert {type(r.score) for r in rows} == {float}  # the clashing text column is replaced
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert set(docs.columns) == set(quality.score(docs, model).columns)


def test_empty_tables(spark):
    docs, labels = brute.frame(spark, []), spark.createDataFrame([], EMPTY)
    model = quality.train(docs, labels)
    assert quality.score(docs, model).collect() == []
    assert np.allclose(quality.scores(pa.array(["any", None]), model), 0.5)


def test_one_class_gives_one_score(spark):
    docs = brute.frame(spark, brute.ODD)
    model = quality.train(docs, spark.createDataFrame([(4, 1), (6, 1)], EMPTY))
    assert len({r.score for r in quality.score(docs, model).collect()}) == 1


def test_repeats_lower_the_score():
    rows, truth = [], []
    for i in range(80):
        text = f"alpha{i} beta{i} gamma{i} delta{i} " * 3 if i % 2 else f"alpha{i} " * 12
        raw = quality.counts_of(pa.array([text]), 12)[0].as_py()
        rows.append(tuple(np.frombuffer(raw, np.int32).reshape(2, -1)))
        truth.append(i % 2)
    model = quality.fit(rows, np.array(truth), 12)
    good, bad = quality.scores(pa.array(["new words follow here each time", "same same same same same same"]), model)
    assert good > 0.5 > bad


def test_training_makes_no_copies_of_its_vectors():
    """All vectors in double precision at once took twice the memory of the model's own and more."""
    rows = [(np.array([1, 2], np.int32), np.array([1, 1], np.int32)), (np.array([3], np.int32), np.array([2], np.int32))]
    tracemalloc.start()
    model = quality.fit(rows, np.array([0, 1]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 4 * quality.DIM * len(model.margins)
