from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from conftest import values
from pyspark.sql import functions as F

from folioseek.operators import embedding
from folioseek.operators.ingest import drain, ingest
from folioseek.plans import sizing
from folioseek.sources.store import ChunkStore
from folioseek.streaming import continuous


def paragraphs(tables, spark, store, checkpoint, folder, documents):
    stream = continuous.document_stream(spark, folder, tables.documents.schema)
    continuous.start_ingest(
        stream, lambda: replace(tables, documents=documents), store, checkpoint, trigger={"availableNow": True},
        splitter=lambda text: text.split("\n\n"), embedder=embedding.hashing_embedder(8), as_of=datetime(2024, 6, 1),
    ).awaitTermination()


def test_store_filled_by_a_batch_job_before(spark, tables):
    folder = sizing.work_path(spark, "arriving")
    store = ChunkStore(spark, sizing.work_path(spark, "stream-store"))
    ingest(tables, store, embedder=embedding.hashing_embedder(8), as_of=datetime(2024, 2, 1))
    changed = tables.documents.filter("id = 1").withColumns(
        {"content": F.lit("fresh"), "modified": F.lit(datetime(2024, 5, 1))}
    )
    changed.write.parquet(folder)
    paragraphs(tables, spark, store, sizing.work_path(spark, "c"), folder, tables.documents)
    assert values(store.chunks().filter("doc_id = 1 AND chunk_index = 1"), "content") == [("fresh",)]
    assert store.sources().count() == 4
    # The same files through a new checkpoint: a replay of the whole stream changes nothing.
    before = values(store.chunks(), "id", "content"), values(store.sources())
    paragraphs(tables, spark, store, sizing.work_path(spark, "c"), folder, tables.documents)
    assert (values(store.chunks(), "id", "content"), values(store.sources())) == before


def test_versions_arrive_restart_and_cleanup(spark, tables):
    folder = sizing.work_path(spark, "arriving")
    checkpoint = sizing.work_path(spark, "stream-checkpoint")
    store = ChunkStore(spark, sizing.work_path(spark, "stream-store"))
    remaining = {"ids": [1, 2, 4, 5]}

    def other_tables():
        return replace(tables, documents=tables.documents.filter(F.col("id").isin(remaining["ids"])))

    def drain():
        stream = continuous.document_stream(spark, folder, tables.documents.schema, files_per_batch=1)
        query = continuous.start_ingest(
            stream, other_tables, store, checkpoint, trigger={"availableNow": True}, cleanup_every=1,
            splitter=lambda text: text.split("\n\n"), embedder=embedding.hashing_embedder(8),
            as_of=datetime(2024, 2, 1) + timedelta(days=len(store.committed_runs())),
        )
        query.awaitTermination()

    first = tables.documents
    older = first.withColumns({"content": F.lit("stale"), "modified": F.col("modified") - F.expr("INTERVAL 1 DAY")})
    first.unionByName(older.filter("modified IS NOT NULL")).coalesce(1).write.mode("append").parquet(folder)
    drain()
    assert values(store.sources(), "doc_id", "status") == [(i, "DONE") for i in (1, 2, 4, 5)]
    assert store.chunks().filter("content = 'stale'").count() == 0

    changed = first.filter("id = 1").withColumns(
        {"content": F.lit("fresh"), "modified": F.lit(datetime(2024, 5, 1))}
    )
    changed.coalesce(1).write.mode("append").parquet(folder)
    remaining["ids"] = [1, 2, 5]
    drain()
    assert values(store.chunks().filter("chunk_index = 1"), "doc_id", "content") == sorted(
        [(1, "fresh"), (2, "second text"), (5, "fifth text")], key=repr
    )
    runs = store.committed_runs()
    drain()
    assert store.committed_runs() == runs


def batch_options(**more):
    return {"splitter": lambda text: text.split("\n\n"), "embedder": embedding.hashing_embedder(8), **more}


def test_an_edit_older_than_the_ingest_clock_is_not_lost(spark, tables):
    folder = sizing.work_path(spark, "arriving")
    store = ChunkStore(spark, sizing.work_path(spark, "stream-store"))
    ingest(tables, store, **batch_options(as_of=datetime(2024, 2, 1)))
    edited = tables.documents.filter("id = 1").withColumns(
        {"content": F.lit("edited"), "modified": F.lit(datetime(2024, 1, 31, 12))}
    )
    edited.write.parquet(folder)
    paragraphs(tables, spark, store, sizing.work_path(spark, "c"), folder, tables.documents)
    assert values(store.chunks().filter("doc_id = 1 AND chunk_index = 1"), "content") == [("edited",)]


def test_failed_documents_are_tried_again(spark, tables):
    folder = sizing.work_path(spark, "arriving")
    store = ChunkStore(spark, sizing.work_path(spark, "stream-store"))

    def down(text):
        raise ValueError("no model")

    ingest(tables, store, splitter=down, embedder=embedding.hashing_embedder(8), as_of=datetime(2024, 2, 1))
    assert values(store.sources(), "status") == [("ERROR",)] * 4
    tables.documents.filter("id = 1").write.parquet(folder)
    paragraphs(tables, spark, store, sizing.work_path(spark, "c"), folder, tables.documents)
    assert values(store.sources(), "status") == [("DONE",)] * 4


def test_cleanup_runs_without_arrivals(spark, tables):
    store = ChunkStore(spark, sizing.work_path(spark, "stream-store"))
    ingest(tables, store, **batch_options(as_of=datetime(2024, 2, 1)))
    left = replace(tables, documents=tables.documents.filter("id <> 4"))
    checkpoint = sizing.work_path(spark, "cleanup")
    for _ in range(2):
        continuous.start_cleanup(spark, lambda: left, store, checkpoint, {"availableNow": True}).awaitTermination()
    assert values(store.sources(), "doc_id") == [(1,), (2,), (5,)]
    assert len(store.committed_runs()) == 2  # nothing was gone the second time


def test_equal_and_null_versions(spark, tables):
    rows = tables.documents
    twice = rows.unionByName(rows).unionByName(rows.withColumn("modified", F.lit(None).cast("timestamp_ntz")))
    newest = continuous.newest_documents(twice)
    assert values(newest, "id", "modified") == values(rows, "id", "modified")


def test_drain_takes_all_in_limited_runs(spark, tables):
    store = ChunkStore(spark, sizing.work_path(spark, "drained"))

    def fails_once(text):
        if "second" in text:
            raise ValueError("cannot split")
        return text.split("\n\n")

    options = {"splitter": fails_once, "embedder": embedding.hashing_embedder(8), "as_of": datetime(2024, 2, 1)}
    assert drain(tables, store, 1, **options) == 4
    assert values(store.sources(), "doc_id", "status") == [(1, "DONE"), (2, "ERROR"), (4, "DONE"), (5, "DONE")]
    assert drain(tables, store, 3, **options) == 1  # only what failed


def test_ten_batches_leave_no_work_folders(spark, tables, tmp_path):
    from pathlib import Path

    from folioseek.plans import sizing

    root = Path(sizing.shared_dir(spark).removeprefix("file:"))
    store = ChunkStore(spark, sizing.work_path(spark, "swept"))
    source = tmp_path / "docs"
    for i in range(10):
        edited = tables.documents.filter("id = 1").withColumns({"content": F.lit(f"text {i}"), "modified": F.lit(datetime(2024, 5, 1 + i))})
        edited.coalesce(1).write.mode("append").parquet(str(source))
    before = {p.name for p in root.iterdir()}
    stream = continuous.document_stream(spark, str(source), tables.documents.schema, files_per_batch=1)
    options = {"splitter": lambda text: text.split("\n\n"), "embedder": embedding.hashing_embedder(8)}
    query = continuous.start_ingest(stream, lambda: tables, store, str(tmp_path / "check"), {"availableNow": True}, cleanup_every=5, **options)
    assert query.awaitTermination(240)
    assert query.exception() is None and len(query.recentProgress) >= 10
    left = {p.name for p in root.iterdir()} - before
    assert left <= {Path(store.root).name}


def test_texts_of_documents_that_came_once_are_not_shuffled(spark, tables):
    rows = tables.documents
    newest = continuous.newest_documents(rows.unionByName(rows.limit(0)))
    assert "Exchange" not in newest._jdf.queryExecution().executedPlan().toString()
    assert values(newest) == values(rows)
    nameless = rows.limit(1).withColumn("id", F.lit(None).cast(rows.schema["id"].dataType))
    assert values(continuous.newest_documents(rows.unionByName(nameless))) == values(rows)
    older = rows.filter("id = 2").withColumns({"content": F.lit("old"), "modified": F.col("modified") - F.expr("INTERVAL 1 DAY")})
    assert values(continuous.newest_documents(older.unionByName(rows))) == values(rows)


def test_folding_past_the_broadcast_bound(spark, tables, monkeypatch):
    rows = tables.documents
    older = rows.filter("id IN (2, 3)").withColumns({"content": F.lit("old"), "modified": F.col("modified") - F.expr("INTERVAL 1 DAY")})
    monkeypatch.setattr(sizing, "fits_broadcast", lambda *a, **b: False)
    assert values(continuous.newest_documents(older.unionByName(rows))) == values(rows)


def test_documents_that_did_not_arrive_are_read_only_when_some_failed(spark, tables):
    folder = sizing.work_path(spark, "arriving")
    store = ChunkStore(spark, sizing.work_path(spark, "stream-store"))
    ingest(tables, store, **batch_options(as_of=datetime(2024, 2, 1)))
    tables.documents.filter("id = 1").withColumn("modified", F.lit(datetime(2024, 5, 1))).write.parquet(folder)
    unread = tables.documents.withColumn("content", F.raise_error(F.lit("read")).cast("string"))
    paragraphs(tables, spark, store, sizing.work_path(spark, "c"), folder, unread)
    assert values(store.run_state(1), "doc_id") == [(1,)]
