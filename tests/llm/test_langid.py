from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa

from folioseek.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op7_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    judged = rows.where("held_out").join(docs, "doc_id").collect()
    assert len(judged) > 100
    assert np.mean([r.lang_pred == r.lang for r in judged]) >= 0.97
    assert rows.where("score < 0 or score > 1 or score is null").count() == 0


def test_odd_rows(spark):
    docs = brute.frame(spark, brute.ODD)
    model = langid.train(docs)
    assert set(model.languages) <= {"en", "de"}
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(brute.ODD)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert 0 <= r.score <= 1


def test_empty_tables(spark):
    docs = brute.frame(spark, [])
    model = langid.train(docs)
    assert langid.identify(docs, model).collect() == []
    assert langid.predict(pa.array(["word", "1", None]), model) == (["und"] * 3, [0.0, 1.0, 1.0])


def test_temperature_calibrates():
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 3, 3000)
    sure = 2.0 * np.eye(3)[truth] + rng.normal(0, 1, (3000, 3))
    t = langid.calibrate(10 * sure, truth)
    assert 3 < t < 30
    assert abs(langid.calibrate(10 * sure / t, truth) - 1) < 0.05


def test_penalty_makes_weights_sparse():
    rng = np.random.default_rng(3)
    rows, truth = [], []
    for i in range(300):
        noise = rng.choice(np.arange(10, 3000), 20, replace=False)
        bucket = np.sort(np.append(noise, i % 2))
        rows.append((bucket, np.full(21, 21**-0.5)))
        truth.append(i % 2)
    weights, _ = langid.fit(rows, np.array(truth), 2)
    assert weights[0, 0] > weights[0, 1] and weights[1, 1] > weights[1, 0]
    assert (weights[3000:] == 0).all()
