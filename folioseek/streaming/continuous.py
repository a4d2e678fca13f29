"""Continuous ingestion: arriving document files drive the batch jobs, one run per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folioseek.operators.ingest import ingest, remove_orphans
from folioseek.operators.sync import latest_versions
from folioseek.plans import sizing
from folioseek.sources.store import ChunkStore
from folioseek.sources.tables import Tables

INGEST_PERIOD = "1 minute"
CLEANUP_PERIOD = "5 minutes"


def document_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def start_ingest(
    documents: DataFrame,
    tables: Callable[[], Tables],
    store: ChunkStore,
    checkpoint: str,
    trigger: dict | None = None,
    cleanup_every: int = 0,
    **options,
) -> StreamingQuery:
    """Ingest each micro-batch of document versions; ``tables`` gives the other tables afresh.

    Only the newest version of a document in a batch counts, and only if the store has an older
    one or none (``staleness="source_version"`` unless told otherwise: files arrive after the
    edit, so the ingest clock would hide edits); so a replayed batch finds its documents up to
    date, and what a batch left half written is overwritten by its replay. Documents that are in
    ERROR are tried again with every batch, with their row from ``tables()`` if no version of
    them arrived. Every ``cleanup_every``-th batch also removes documents that ``tables()`` no
    longer holds; ``start_cleanup`` does so on its own clock.
    """
    options = {"staleness": "source_version"} | options

    def step(batch: DataFrame, batch_id: int) -> None:
        with store.writing():
            now = tables()
            arrived = newest_documents(batch)
            failed = store.sources().filter("status = 'ERROR'").select(F.col("doc_id").alias("id"))
            waiting = sizing.materialize(failed.join(arrived.select("id"), "id", "left_anti"), "waiting")
            due = arrived
            if not waiting.isEmpty():  # else the other documents are not read at all
                ids = F.broadcast(waiting) if sizing.fits_broadcast(waiting) else waiting
                due = arrived.unionByName(now.documents.join(ids, "id", "left_semi").select(*arrived.columns))
            ingest(replace(now, documents=due), store, **options)
            sizing.release(waiting)
            if cleanup_every and (batch_id + 1) % cleanup_every == 0:
                remove_orphans(now, store)

    writer = documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": INGEST_PERIOD})).start()


def newest_documents(batch: DataFrame) -> DataFrame:
    """The newest version of each document; rows without an id are left out.

    A document that came once is its own newest version, so only the ids are counted for it. Those that came
    more often are picked out within the broadcast bound and folded alone; past it all are folded.
    """
    known = batch.filter(F.col("id").isNotNull())
    repeated = known.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("id")
    if repeated.isEmpty():
        return known
    if not sizing.fits_broadcast(repeated, measure=True):
        return _folded(known)
    several = F.broadcast(repeated)
    once = known.join(several, "id", "left_anti").select(*batch.columns)
    return once.unionByName(_folded(known.join(several, "id", "left_semi").select(*batch.columns)))


def _folded(batch: DataFrame) -> DataFrame:
    """The newest of all versions of each document; versions are folded without the document's text."""
    wide = [c for c in batch.columns if c not in ("id", "modified")]
    marked = batch.withColumn("_mark", F.xxhash64(*wide))
    newest = latest_versions(marked.select("id", "modified", "_mark"), "id", "modified", "_mark")
    kept = marked.join(newest.select("id", "_mark", F.struct("modified").alias("_newest")), ["id", "_mark"])
    same = F.col("modified").eqNullSafe(F.col("_newest.modified"))
    return kept.filter(same).dropDuplicates(["id"]).select(*batch.columns)


def start_cleanup(
    spark: SparkSession,
    tables: Callable[[], Tables],
    store: ChunkStore,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Remove documents that ``tables()`` no longer holds on a clock, whether or not any arrive."""

    def step(batch: DataFrame, batch_id: int) -> None:
        with store.writing():
            remove_orphans(tables(), store)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": CLEANUP_PERIOD})).start()
