"""The ingest and cleanup jobs over a chunk store."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.functions import text
from folioseek.operators import chunking, sync
from folioseek.operators.documents import documents_view
from folioseek.operators.embedding import Embedder, hashing_embedder
from folioseek.plans import sizing
from folioseek.sources.store import ChunkStore
from folioseek.sources.tables import Tables


def rendered(view: DataFrame) -> DataFrame:
    """``(doc_id, text, metadata)`` of document view rows."""
    return view.select(
        F.col("id").alias("doc_id"),
        text.render_document("title", "correspondent_name", "document_date", "content", "note").alias("text"),
        F.to_json(
            text.metadata_map("id", "title", "correspondent_name", "document_date", "owner_username", "tags")
        ).alias("metadata"),
    )


def outcomes(candidates: DataFrame, staged: DataFrame) -> DataFrame:
    """``(doc_id, error)`` per candidate: a failed piece or a missing embedding fails its document.

    Counted per document with map-side partials; a document without chunks is done.
    """
    counts = staged.groupBy("doc_id").agg(
        F.min("error").alias("failure"),
        F.count("content").alias("segments"),
        F.count("embedding").alias("embeddings"),
    )
    mismatch = F.when(F.col("segments") != F.col("embeddings"), text.count_mismatch("embeddings", "segments"))
    error = F.coalesce("failure", mismatch)
    return candidates.select("doc_id").join(counts, "doc_id", "left").select("doc_id", error.alias("error"))


def ingest(
    tables: Tables,
    store: ChunkStore,
    splitter: chunking.Splitter = chunking.split_text,
    embedder: Embedder | None = None,
    as_of=None,
    limit: int | None = None,
    run: int | None = None,
    note_join: str = "legacy",
    staleness: str = "ingest_time",
    with_metadata: bool = True,
) -> int:
    """Bring the store up to date with the documents; returns the run number.

    All candidates are processed in one pass, each once; ``limit`` takes the oldest changes
    only. A run that is already committed is left alone, so a replay changes nothing; when
    nothing is due no run is committed.
    """
    if run is not None and store.is_committed(run):
        return run
    embedder = embedder or hashing_embedder()
    known = store.sources()
    due = sync.ingest_candidates(replace(tables, sources=known), limit, staleness)
    candidates = sizing.materialize(due, "candidates")
    if candidates.isEmpty():
        sizing.release(candidates)
        return store.next_run() if run is None else run
    run = store.claim_run() if run is None else run

    ids = candidates.select(F.col("doc_id").alias("id"))
    note_join = "fk_first" if note_join == "fk" else note_join
    spread = replace(tables, documents=sizing.fill_cores(tables.documents, "id"))
    docs = rendered(documents_view(spread, only_ids=ids, note_join=note_join, ordered=False))
    pieces = chunking.chunk_documents(docs, splitter, carry=("metadata",))
    embedded = embedder(pieces, "content").withColumns({
        "id": sync.chunk_id("doc_id", "chunk_index"),
        "error": F.coalesce("error", "embedding_error"),
        "metadata": F.col("metadata") if with_metadata else F.lit(None).cast("string"),
        "created_at": sync.moment(as_of),
    })
    staged = store.write_chunks(run, embedded)

    before = known.join(candidates.select("doc_id"), "doc_id", "left_semi")
    started = sync.begin_ingest(before, candidates, as_of)
    ended = sync.finish_ingest(started, outcomes(candidates, staged), as_of)
    done = F.col("status") == "DONE"
    state = ended.withColumns({
        "chunk_run": F.when(done, F.lit(run)).otherwise(F.col("chunk_run")),
        "deleted": F.lit(False),
    })
    store.commit(run, state)
    sizing.release(candidates)
    return run


def remove_orphans(tables: Tables, store: ChunkStore, run: int | None = None) -> int:
    """Drop state and chunks of documents that are gone; returns the run number.

    When nothing is gone no run is committed.
    """
    if run is not None and store.is_committed(run):
        return run
    gone = sizing.materialize(sync.orphans(store.sources(), tables.documents), "orphans")
    if gone.isEmpty():
        run = store.next_run() if run is None else run
    else:
        run = store.claim_run() if run is None else run
        store.commit(run, gone.withColumn("deleted", F.lit(True)))
    sizing.release(gone)
    return run


def drain(tables: Tables, store: ChunkStore, batch: int = sync.INGEST_BATCH, **options) -> int:
    """Ingest in runs of at most ``batch`` documents, oldest change first, until none is due.

    A document that fails is tried once: what is in ERROR after its run waits for the next call.
    Returns the number of runs.
    """
    runs = 0
    tried = None
    while True:
        due = tables.documents
        if tried is not None:
            due = due.join(tried, "id", "left_anti")
        run = ingest(replace(tables, documents=due), store, limit=batch, **options)
        ended = store.run_state(run)
        if ended.isEmpty():
            if tried is not None:
                sizing.release(tried)
            return runs
        runs += 1
        failed = ended.filter("status = 'ERROR'").select(F.col("doc_id").alias("id"))
        before, tried = tried, sizing.materialize(failed if tried is None else tried.union(failed), "tried")
        if before is not None:
            sizing.release(before)
