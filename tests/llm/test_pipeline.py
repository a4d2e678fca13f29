from __future__ import annotations

import zlib
from collections import Counter

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_decontaminate import plain as contaminated
from tokenizers import Tokenizer

import corpus_pipeline
from folioseek.llm import quality
from folioseek.plans.sizing import materialize


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What goes into each stage, and at last what comes out."""
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], sf_dir), name))
    return docs


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_quality_keeps_the_good(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality.fold("doc_id", 3) == 1)
    kept = labels.join(stages[1], "doc_id", "left_semi")
    good, bad = labels.where("quality = 1").count(), labels.where("quality = 0").count()
    assert kept.where("quality = 1").count() >= 0.97 * good
    assert kept.where("quality = 0").count() <= 0.1 * bad


def test_one_of_each_group_stays(stages):
    rows = texts(stages[1])
    want = brute.components(rows, 5, 80, 100)
    assert sorted(k for k, _ in texts(stages[2])) == sorted(k for (k, _), c in zip(rows, want, strict=True) if k == c)


def test_contaminated_ones_go(spark, sf_dir, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = sorted(r[0] for r in contaminated(texts(stages[2]), items) if not r[4])
    assert sorted(k for k, _ in texts(stages[3])) == want


def test_mixture_meets_its_budget(stages):
    before, after = ({k: len(brute.words(t)) for k, t in texts(df)} for df in (stages[3], stages[4]))
    times = Counter(k for k, _ in texts(stages[4]))
    assert set(after) <= set(before) and max(times.values()) <= corpus_pipeline.MIX_EPOCHS
    total, mixed = sum(before.values()), sum(before[k] * n for k, n in times.items())
    # documents in which a budget ends come whole: at most one per leaf
    leaves = stages[3].select("lang", "source").distinct().count()
    assert 0 <= mixed - int(total * corpus_pipeline.MIX_SHARE) + leaves <= leaves * (max(before.values()) + 1)


def test_tokens_of_the_mixture(stages):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    want = []
    for key, text in texts(stages[4]):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    found = stages[5].orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == sorted(want)
    assert [r.doc_id for r in found] == sorted(k for k, _, _ in want)
    start = 0
    for r in found:
        assert r.start == start
        start += r.n_tokens


def test_odd_rows_pass_through(spark, sf_dir):
    docs = brute.frame(spark, brute.ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert set(map(str, out.collect())) <= set(map(str, docs.collect()))
    last = corpus_pipeline.token_ids(spark, docs, sf_dir)
    assert last.count() == len(brute.ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, brute.frame(spark, []), sf_dir).where(F.lit(True)).count() == 0
