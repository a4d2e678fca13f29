from __future__ import annotations

from datetime import datetime

from conftest import at, values
from pyspark.sql import functions as F

from folioseek.operators import quality, sync

NOW = datetime(2024, 2, 1)


def test_candidates(tables):
    due = sync.ingest_candidates(tables, limit=None)
    # 1 changed after its ingest; 5 is new. 2 is up to date, 3 is no PDF, 4 is RUNNING without a time.
    assert values(due, "doc_id", "title", "correspondent_name") == [(1, "One", "ACME"), (5, "Five", "ACME")]


def test_oldest_first_with_missing_times_last(tables):
    assert [r["doc_id"] for r in sync.ingest_candidates(tables, limit=5).collect()] == [1, 5]
    assert [r["doc_id"] for r in sync.ingest_candidates(tables, limit=1).collect()] == [1]


def test_errors_and_versions(spark, tables):
    from dataclasses import replace

    failed = tables.sources.withColumn("status", F.when(F.col("doc_id") == 2, "ERROR").otherwise(F.col("status")))
    assert values(sync.ingest_candidates(replace(tables, sources=failed), None), "doc_id") == [(1,), (2,), (5,)]
    # By version: 1 was ingested from a version of day 1, 4 from the one it still has.
    by_version = sync.ingest_candidates(tables, None, staleness="source_version")
    assert values(by_version, "doc_id") == [(1,), (5,)]


def test_begin_and_finish(spark, tables):
    due = sync.ingest_candidates(tables, limit=None)
    started = sync.begin_ingest(tables.sources, due, NOW)
    rows = {r["doc_id"]: r for r in started.collect()}
    assert set(rows) == {1, 2, 4, 5, 77}
    assert rows[1]["status"] == "RUNNING" and rows[1]["last_ingested_at"] is None
    assert rows[1]["source_modified_at"] == at(3, 10) or rows[1]["source_modified_at"] == at(3)
    assert rows[1]["created_at"] == at(1) and rows[5]["created_at"] == NOW
    assert rows[2]["updated_at"] == at(4)
    outcome = spark.createDataFrame([(1, None), (5, "boom")], "doc_id long, error string")
    rows = {r["doc_id"]: r for r in sync.finish_ingest(started, outcome, NOW).collect()}
    assert (rows[1]["status"], rows[1]["error_message"], rows[1]["last_ingested_at"]) == ("DONE", None, NOW)
    assert (rows[5]["status"], rows[5]["error_message"], rows[5]["last_ingested_at"]) == ("ERROR", "boom", NOW)
    assert rows[4]["status"] == "RUNNING"


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, "id long, doc_id long, chunk_index int, content string")


def test_replace_chunks(spark):
    old = chunks_of(spark, [(1, 1, 0, "a"), (2, 1, 1, "b"), (3, 2, 0, "c")])
    new = chunks_of(spark, [(9, 1, 0, "z")])
    done = spark.createDataFrame([(1,)], "doc_id long")
    assert values(sync.replace_chunks(old, done, new)) == [(3, 2, 0, "c"), (9, 1, 0, "z")]


def test_cleanup_twice(spark, tables):
    chunks = chunks_of(spark, [(1, 77, 0, "gone"), (2, 1, 0, "kept")])
    sources, left = sync.cleanup(tables.sources, chunks, tables.documents)
    assert values(sources, "doc_id") == [(1,), (2,), (4,)] and values(left, "id") == [(2,)]
    again, still = sync.cleanup(sources, left, tables.documents)
    assert values(again, "doc_id") == [(1,), (2,), (4,)] and values(still, "id") == [(2,)]
    assert values(sync.oldest_orphans(tables.sources, tables.documents), "doc_id") == [(77,)]


def test_defaults(spark):
    rows = spark.createDataFrame([(5, None), (3, "DONE")], "doc_id long, status string")
    filled = sync.with_defaults(rows, 10, NOW)
    assert values(filled, "doc_id", "status", "created_at", "updated_at", "id") == sorted(
        [(3, "DONE", NOW, NOW, 11), (5, "PENDING", NOW, NOW, 12)], key=repr
    )


def test_chunk_ids_are_unique(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2**31 - 1, 2**31 - 1)], "d long, i int")
    ids = [r["id"] for r in df.select(sync.chunk_id("d", "i").alias("id")).collect()]
    assert len(set(ids)) == 4


def test_latest_versions(spark):
    rows = [(1, at(1), "old"), (1, at(2), "new"), (2, at(1), "only"), (3, None, "none"), (3, at(1), "some")]
    df = spark.createDataFrame(rows, "id long, modified timestamp_ntz, v string")
    assert values(sync.latest_versions(df, "id", "modified"), "id", "v") == [(1, "new"), (2, "only"), (3, "some")]


def test_quality(spark, tables):
    assert values(quality.duplicate_keys(tables.document_tags, "document_id", "tag_id")) == [(1, 20, 2)]
    assert values(quality.missing_parents(tables.documents, "owner_id", tables.users, "id")) == [(999, 1)]
    assert values(quality.missing_parents(tables.document_tags, "tag_id", tables.tags, "id")) == [(404, 1)]
    rules = {**quality.not_null("title"), **quality.allowed("mime_type", ("application/pdf",))}
    assert values(quality.rule_violations(tables.documents, rules)) == [("mime_type allowed", 1), ("title not null", 1)]
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, None)], "id int, e array<float>")
    assert values(quality.wrong_dimensions(vectors, "e", 2), "id") == [(1,)]
    assert values(quality.dimension_summary(vectors, "e")) == sorted([(1, 1), (2, 1), (None, 1)], key=repr)
