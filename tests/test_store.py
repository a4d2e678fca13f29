from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from conftest import at, values
from pyspark.sql import functions as F

from folioseek.operators import embedding, ingest, search, sync
from folioseek.plans import sizing
from folioseek.sources.store import CHUNKS, STATE, ChunkStore, RunTaken

START = datetime(2024, 2, 1)


def paragraphs():
    """A splitter that workers need not import."""

    def split(text: str) -> list[str]:
        if "explode" in text:
            raise ValueError("cannot split this")
        return text.split("\n\n")

    return split


@pytest.fixture
def store(spark):
    return ChunkStore(spark, sizing.work_path(spark, "test-store"))


def run(tables, store, when=START, **options):
    options = {"splitter": paragraphs(), "embedder": embedding.hashing_embedder(16), "as_of": when, **options}
    return ingest.ingest(tables, store, **options)


def with_text(tables, doc_id, content, modified):
    hit = F.col("id") == doc_id
    return replace(tables, documents=tables.documents.withColumns({
        "content": F.when(hit, F.lit(content)).otherwise(F.col("content")),
        "modified": F.when(hit, F.lit(modified)).otherwise(F.col("modified")),
    }))


def test_first_run(tables, store):
    assert store.sources().count() == 0 and store.chunks().count() == 0
    run(tables, store)
    assert values(store.sources(), "doc_id", "status", "last_ingested_at") == [
        (i, "DONE", START) for i in (1, 2, 4, 5)
    ]
    first = store.chunks().filter("doc_id = 1").orderBy("chunk_index").collect()
    assert [r["content"] for r in first] == ["Title: One\nCorrespondent: ACME\nDate: 2024-01-01", "first text", "Note: note one\n"]
    assert [r["chunk_index"] for r in first] == [0, 1, 2] and len(first[0]["embedding"]) == 16
    assert '"tags":"a,b,b"' in first[0]["metadata"]


def test_second_run_does_nothing(tables, store):
    run(tables, store)
    before = values(store.chunks(), "id", "content")
    current = replace(tables, sources=store.sources())
    # Document 5 has no change time, so only its absence made it a candidate.
    assert sync.ingest_candidates(current, None).count() == 0
    run(tables, store, START + timedelta(hours=1))
    assert values(store.chunks(), "id", "content") == before


def test_changed_document_is_replaced(tables, store):
    run(tables, store)
    changed = with_text(tables, 1, "new text", START + timedelta(days=1))
    run(changed, store, START + timedelta(days=2))
    assert values(store.chunks().filter("chunk_index = 1"), "doc_id", "content") == sorted(
        [(1, "new text"), (2, "second text"), (4, "fourth text"), (5, "fifth text")], key=repr
    )
    state = store.sources().filter("doc_id = 1").first()
    assert state["last_ingested_at"] == START + timedelta(days=2) and state["created_at"] == START


def test_failing_document_is_marked_hidden_and_tried_again(tables, store):
    run(tables, store)
    broken = with_text(tables, 1, "explode", START + timedelta(days=1))
    run(broken, store, START + timedelta(days=2))
    state = {r["doc_id"]: (r["status"], r["error_message"]) for r in store.sources().collect()}
    assert state[1] == ("ERROR", "cannot split this") and state[2] == ("DONE", None)
    # Its old chunks stay stored but are not searchable.
    assert store.chunks().filter("doc_id = 1").count() == 3
    assert search.searchable(store.chunks(), store.sources()).filter("doc_id = 1").count() == 0
    assert store.chunks(status="DONE").filter("doc_id = 1").count() == 0
    run(with_text(tables, 1, "fixed", START + timedelta(days=1)), store, START + timedelta(days=3))
    assert store.sources().filter("doc_id = 1").first()["status"] == "DONE"
    assert store.chunks().filter("doc_id = 1 AND chunk_index = 1").first()["content"] == "fixed"


def test_failing_embedding_fails_its_document_only(tables, store):
    def factory():
        def model(texts):
            if any("second" in t for t in texts):
                raise RuntimeError("model is down")
            return [[1.0, 2.0] for _ in texts]

        return model

    run(tables, store, embedder=embedding.model_embedder(factory, dim=2))
    state = {r["doc_id"]: (r["status"], r["error_message"]) for r in store.sources().collect()}
    assert state == {1: ("DONE", None), 2: ("ERROR", "model is down"), 4: ("DONE", None), 5: ("DONE", None)}
    assert store.chunks().filter("doc_id = 2").count() == 0


def test_short_answers_and_wrong_widths(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", None, "ccc", "dddd"])], "i int, t string")

    def short():
        return lambda texts: [[float(len(t)), 0.0] for t in texts if t != "bb"]

    rows = {r["i"]: r for r in embedding.model_embedder(short, dim=2)(df, "t").collect()}
    assert rows[0]["embedding"] == [1.0, 0.0] and rows[4]["embedding"] == [4.0, 0.0]
    assert rows[1]["embedding"] is None and rows[1]["embedding_error"] == "0 vectors for 1 segments"
    assert rows[2]["embedding"] is None and rows[2]["embedding_error"] is None
    wide = embedding.model_embedder(lambda: lambda texts: [[1.0] * len(t) for t in texts], dim=2)(df, "t")
    assert values(wide.filter("embedding IS NOT NULL"), "t") == [("bb",)]


def test_hashing_embedder(spark):
    df = spark.createDataFrame([("a b", ), ("B a!",), ("c",), ("...",), (None,)], "t string")
    rows = [r["embedding"] for r in embedding.hashing_embedder(8)(df, "t").collect()]
    assert rows[0] == rows[1] and rows[3] == [0.0] * 8 and rows[4] is None
    assert sum(x * x for x in rows[0]) == pytest.approx(1.0, abs=1e-6)


def test_hashing_embedder_against_plain_counting(spark, sf_dir):
    import math
    import re
    from collections import Counter

    from pyspark.ml.feature import HashingTF

    dim = 32
    slot = HashingTF(inputCol="w", outputCol="f", numFeatures=dim)
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    slots: dict[str, int] = {}
    for row in embedding.hashing_embedder(dim)(texts, "text").collect():
        counts = Counter(re.findall(r"[^\W_]+", row["text"].lower()))
        expected = [0.0] * dim
        for word, n in counts.items():
            if word not in slots:
                slots[word] = slot.indexOf(word)
            expected[slots[word]] += n
        size = math.sqrt(sum(x * x for x in expected)) or 1.0
        assert row["embedding"] == pytest.approx([x / size for x in expected], abs=1e-6)


def test_committed_run_is_not_run_again(tables, store):
    assert run(tables, store, run=4) == 4
    before = values(store.chunks(), "id")
    changed = with_text(tables, 1, "new text", START + timedelta(days=1))
    assert run(changed, store, START + timedelta(days=2), run=4) == 4
    assert values(store.chunks(), "id") == before and store.committed_runs() == [4]


def test_chunks_without_state_are_invisible(tables, store):
    run(tables, store)
    before = values(store.chunks(), "id")
    # A run that died after its chunks and before its state.
    store.write_chunks(1, store.chunks().withColumn("content", F.lit("half done")))
    assert values(store.chunks(), "id") == before
    assert store.chunks().filter("content = 'half done'").count() == 0
    changed = with_text(tables, 1, "new text", START + timedelta(days=1))
    assert run(changed, store, START + timedelta(days=2)) == 1
    assert store.chunks().filter("content = 'half done'").count() == 0


def test_orphans(tables, store):
    run(tables, store)
    fewer = replace(tables, documents=tables.documents.filter("id <> 4"))
    ingest.remove_orphans(fewer, store)
    assert values(store.sources(), "doc_id") == [(1,), (2,), (5,)]
    assert store.chunks().filter("doc_id = 4").count() == 0
    again = ingest.remove_orphans(fewer, store)
    assert values(store.sources(), "doc_id") == [(1,), (2,), (5,)] and again not in store.committed_runs()
    # A document that comes back is new.
    run(tables, store, START + timedelta(days=1))
    assert store.sources().filter("doc_id = 4").first()["created_at"] == START + timedelta(days=1)


def test_oldest_only(tables, store):
    run(tables, store, limit=2)
    assert values(store.sources(), "doc_id") == [(1,), (2,)]
    run(tables, store, limit=2)
    assert values(store.sources(), "doc_id") == [(1,), (2,), (4,), (5,)]


def test_document_that_stops_being_a_pdf_stays_searchable(tables, store):
    run(tables, store)
    other = replace(tables, documents=tables.documents.withColumn("mime_type", F.lit("image/png")))
    run(other, store, START + timedelta(days=1))
    ingest.remove_orphans(other, store)
    assert store.chunks(status="DONE").filter("doc_id = 1").count() == 3


def test_compact(spark, tables, store):
    run(tables, store)
    run(with_text(tables, 1, "new text", START + timedelta(days=1)), store, START + timedelta(days=2))
    small = store.compact(sizing.work_path(spark, "compacted"))
    assert small.committed_runs() == [0]
    assert values(small.chunks(), "id", "content") == values(store.chunks(), "id", "content")
    assert values(small.sources().drop("chunk_run")) == values(store.sources().drop("chunk_run"))


def test_search_by_own_chunk(spark, tables, store):
    run(tables, store)
    text = store.chunks().filter("doc_id = 4").orderBy("chunk_index").first()["content"]
    requests = search.validate_requests(
        spark.createDataFrame([(1, text, 15), (2, "  ", 3)], "request_id long, query string, top_k int")
    )
    asked = embedding.embed_queries(requests, embedding.hashing_embedder(16))
    hits = search.search(store.chunks(), store.sources(), asked).collect()
    assert hits and {r["query_id"] for r in hits} == {1}
    assert any(r["doc_id"] == 4 for r in hits)
    assert sorted(map(tuple, search.search_store(store, asked, 15).collect())) == sorted(map(tuple, hits))
    best = min(hits, key=lambda r: r["rank"])
    assert best["score"] <= max(r["score"] for r in hits)
    assert best["source_url"].endswith(f"/documents/{best['doc_id']}")


def test_metadata_can_be_left_out(tables, store):
    run(tables, store, with_metadata=False)
    assert store.chunks().filter("metadata IS NOT NULL").count() == 0


def test_foreign_key_notes(tables, store):
    run(tables, store, note_join="fk")
    last = store.chunks().filter("doc_id = 2 AND chunk_index = 2").first()["content"]
    assert last == "Note: note one\n"
    assert at(1)


def test_a_model_that_is_down_costs_few_calls(spark):
    calls = spark.sparkContext.accumulator(0)

    def down():
        def embed(texts):
            calls.add(1)
            raise OSError("no route")

        return embed

    df = spark.range(2000).select("id", F.lit("text").alias("t")).coalesce(1)
    rows = embedding.model_embedder(down, dim=2, batch_size=100, wait=0.0, failures=10)(df, "t").collect()
    assert len(rows) == 2000 and {r.embedding_error for r in rows} == {"no route"}
    assert calls.value <= 10 + 2000 // 100


def test_a_call_that_fails_once_is_made_again(spark):
    def shaky():
        failed = []

        def embed(texts):
            if not failed:
                failed.append(1)
                raise OSError("busy")
            return [[1.0, 2.0]] * len(texts)

        return embed

    df = spark.range(10).select("id", F.lit("text").alias("t")).coalesce(1)
    rows = embedding.model_embedder(shaky, dim=2, wait=0.0)(df, "t").collect()
    assert {r.embedding_error for r in rows} == {None}


def test_folded_stores_read_one_run(spark, tables):
    store = ChunkStore(spark, sizing.work_path(spark, "folded"))
    options = {"splitter": lambda text: text.split("\n\n"), "embedder": embedding.hashing_embedder(8)}
    for day in range(1, 9):
        edited = tables.documents.withColumns(
            {"content": F.lit(f"text of day {day}"), "modified": F.lit(datetime(2024, 3, day))}
        )
        ingest.ingest(replace(tables, documents=edited), store, as_of=datetime(2024, 3, day, 1), **options)
    ingest.remove_orphans(replace(tables, documents=tables.documents.filter("id <> 4")), store)
    before = values(store.chunks()), values(store.sources().drop("chunk_run"))
    assert len(store.committed_runs()) == 9
    run = store.fold()
    assert store.committed_runs() == [run] and store.next_run() == run + 1
    assert (values(store.chunks()), values(store.sources().drop("chunk_run"))) == before
    assert all(f"run={run}/" in f for f in store.chunks().inputFiles() + store.sources().inputFiles())
    assert all(store.is_committed(old) for old in range(run + 1)) and not store.is_committed(run + 1)
    # replaying a run from before the fold changes nothing, later runs go on
    assert ingest.ingest(tables, store, run=0, **options) == 0
    newest = tables.documents.filter("id = 1").withColumns({"content": F.lit("new"), "modified": F.lit(datetime(2024, 4, 1))})
    ingest.ingest(replace(tables, documents=newest), store, as_of=datetime(2024, 4, 2), **options)
    assert values(store.chunks().filter("doc_id = 1 AND chunk_index = 1"), "content") == [("new",)]
    assert store.fold() == run + 2


def test_current_chunks_are_joined_by_bucket_without_an_exchange(spark, tables):
    store = ChunkStore(spark, sizing.work_path(spark, "bucketed"), buckets=3)
    run(tables, store)
    run(with_text(tables, 1, "new text", START + timedelta(days=1)), store, START + timedelta(days=2))
    for status in (None, "DONE"):
        far = store.chunks(status, limit=-1)
        plan = far._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "SelectedBucketsCount: 3 out of 3" in plan
        assert values(far) == values(store.chunks(status))
    # a catalog that knows nothing of the store finds it by its folder
    for table in ("chunks", "state"):
        spark.sql(f"DROP TABLE {store._table(table, CHUNKS if table == 'chunks' else STATE, 3)}")
    other = ChunkStore(spark.newSession(), store.root, buckets=7)
    assert values(other.chunks()) == values(store.chunks()) and other._bucket_count(create=True) == 3


def test_two_writers_on_one_store(spark, tables):
    """Two applications, as their own objects and without the lock of one process."""
    root = sizing.work_path(spark, "shared")
    mine, theirs = ChunkStore(spark, root), ChunkStore(spark.newSession(), root)
    a, b = mine.claim_run(), theirs.claim_run()
    assert (a, b) == (0, 1)
    half = replace(tables, documents=tables.documents.filter("id < 3")), replace(tables, documents=tables.documents.filter("id >= 3"))
    for one, number, part in ((theirs, b, half[1]), (mine, a, half[0])):  # the later number commits first
        run(part, one, run=number)
    assert mine.committed_runs() == theirs.committed_runs() == [0, 1]
    assert values(theirs.sources(), "doc_id") == [(1,), (2,), (4,), (5,)]
    assert values(mine.chunks(), "id") == values(theirs.chunks(), "id") and mine.chunks().count() == 12
    with pytest.raises(RunTaken):
        theirs.commit(a, theirs.sources().withColumns({"chunk_run": F.lit(0), "deleted": F.lit(False)}))
    assert mine.claim_run() == 2 and theirs.claim_run() == 3


def test_runs_leave_no_work_folders(spark, tables, store):
    from pathlib import Path

    def folders():
        return {p.name for p in Path(sizing.shared_dir(spark).removeprefix("file:")).iterdir()}

    run(tables, store)
    before = folders()
    for day in range(1, 4):
        run(with_text(tables, 1, f"text {day}", START + timedelta(days=day)), store, START + timedelta(days=day, hours=1))
        run(tables, store, START + timedelta(days=day, hours=2))
    ingest.remove_orphans(replace(tables, documents=tables.documents.filter("id <> 4")), store)
    ingest.drain(tables, store, batch=2, splitter=paragraphs(), embedder=embedding.hashing_embedder(16))
    assert folders() == before
