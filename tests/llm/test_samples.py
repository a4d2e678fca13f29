from __future__ import annotations

import brute
import numpy as np
from pyspark.sql import functions as F

from folioseek.llm import langid, pii, quality, samples


def test_one_row_comes_out_of_ten_thousand(spark):
    docs = spark.range(10_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") + 10_000).alias("text"))
    docs = docs.union(spark.createDataFrame([(1, None), (2, None), (3, "x")], "doc_id long, text string"))
    chosen = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, mark string")
    found = samples.one_text_each(docs, chosen, "doc_id").collect()
    assert sorted(map(tuple, found)) == [(1, "a", "t10000"), (3, "c", "x")]


def test_collected_within_a_bound(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 5 + 1, "v" * i) for i in range(50)] + [(99, 1000, "big")], "i int, n int, v string")
    found = samples.collected(rows, "n", 40, -F.col("i")).to_pylist()
    want, total = [], 0
    for i in range(49, -1, -1):
        total += (i * 7) % 5 + 1
        if total > 40:
            break
        want.append(i)
    assert [r["i"] for r in found] == want and found[0]["v"] == "v" * 49
    assert len(samples.collected(rows.limit(0), "n", 40, "i")) == 0


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4E00 + i % 300) * 3} {chr(0x4E00 + i % 300)}a", f"l{i % 300}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 300
    few = langid.train(docs, rows=600)  # five documents of each at least
    assert len(few.languages) == 300
    told = langid.identify(docs.where("doc_id < 300"), model).collect()
    assert sum(r.lang_pred == r.lang for r in told) > 270


def test_repeats_of_a_sampled_id_teach_once(spark):
    plain = [(i, f"mail a{i}@b.de or call +49 30 12345{i:03d} now", "en" if i % 2 else "de", i % 2) for i in range(40)]
    many = plain + [(7, f"zz other {k}", "en", 1) for k in range(3000)]
    docs, repeated = (spark.createDataFrame(r, "doc_id bigint, text string, lang string, quality int") for r in (plain, many))
    labels = docs.select("doc_id", "quality")
    assert quality.train(repeated, labels).margins.tolist() == quality.train(docs, labels).margins.tolist()
    a, b = (vars(pii.train(d)) for d in (repeated, docs))
    assert all(np.array_equal(a[k], b[k]) for k in a)
    assert langid.train(repeated).languages == ("de", "en")


def test_documents_full_of_numbers_teach_too(spark):
    """The order of the sample does not ask how many marked words a document has."""
    heavy = [(i, " ".join(["id 4111 1111 1111 1111"] * 40)) for i in range(30)]
    light = [(100 + i, f"only {i}") for i in range(30)]
    docs = spark.createDataFrame(heavy + light, "doc_id bigint, text string")
    seen = []
    kept, pii.fit = pii.fit, lambda g, labels: seen.append(labels) or kept(g, labels)
    try:
        pii.train(docs, words=1600)
    finally:
        pii.fit = kept
    assert 0 < len(seen[0]) <= 1600 and (seen[0] > 0).sum() > 160


def test_odd_rows_train(spark):
    docs = brute.frame(spark, brute.ODD)
    labels = spark.createDataFrame([(k, i % 2) for i, (k, _) in enumerate(brute.ODD) if k is not None], "doc_id bigint, quality int").distinct()
    quality.train(docs, labels)
    pii.train(docs)
