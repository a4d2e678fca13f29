"""Ingest state: candidates, status transitions, replacement and cleanup as pure DataFrame steps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.functions import text
from folioseek.operators.documents import is_pdf
from folioseek.plans import sizing
from folioseek.plans.ordering import oldest_first, top
from folioseek.sources.tables import Tables

STATE_COLUMNS = (
    "doc_id", "title", "correspondent", "doc_date", "source_modified_at", "last_ingested_at", "status",
    "error_message", "created_at", "updated_at",
)
#: Documents per run of the source system's jobs; callers who want such runs pass them.
INGEST_BATCH = 20
CLEANUP_BATCH = 50


def moment(as_of: datetime | str | None) -> Column:
    """A passed instant, so that runs repeat, or the time of the query."""
    if as_of is None:
        return F.localtimestamp()
    return F.lit(str(as_of)).cast("timestamp_ntz")


def stale(staleness: str = "ingest_time") -> Column:
    """Absent, changed since the last ingest, or failed; null times never count as changed.

    ``ingest_time`` compares with the clock of the last ingest, as the source system does;
    ``source_version`` compares with the document version that was ingested and so cannot
    miss an edit made while an ingest ran.
    """
    seen = {"ingest_time": "last_ingested_at", "source_version": "source_modified_at"}[staleness]
    return F.col("_known").isNull() | (F.col("modified") > F.col(seen)) | (F.col("status") == "ERROR")


def ingest_candidates(
    tables: Tables, limit: int | None = None, staleness: str = "ingest_time"
) -> DataFrame:
    """PDF documents that need ingesting; with a ``limit`` the oldest changes, in their order."""
    docs = tables.documents.filter(is_pdf()).select("id", "title", "modified", "created", "correspondent_id")
    state = tables.sources.select(
        F.col("doc_id").alias("id"), "status", "last_ingested_at", "source_modified_at", F.lit(True).alias("_known")
    )
    due = docs.join(state, "id", "left").filter(stale(staleness))
    names = tables.correspondents.select(F.col("id").alias("correspondent_id"), F.col("name").alias("_name"))
    named = sizing.lookup_join(due, names, "correspondent_id", spread="id").select(
        F.col("id").alias("doc_id"),
        text.or_untitled("title").alias("title"),
        text.or_empty("_name").alias("correspondent_name"),
        F.col("modified").alias("modified_at"),
        F.col("created").alias("created_at"),
    )
    return named if limit is None else top(named, oldest_first("modified_at", "doc_id"), limit)


def begin_ingest(sources: DataFrame, candidates: DataFrame, as_of=None) -> DataFrame:
    """Upsert: candidates become RUNNING rows with fresh descriptive columns; the rest stay.

    One full outer join on the unique document id covers insert, update and untouched rows.
    Columns that ingestion does not set pass through.
    """
    now = moment(as_of)
    fresh = candidates.select(
        "doc_id",
        F.struct(
            "title", F.col("correspondent_name").alias("correspondent"), F.col("created_at").alias("doc_date"),
            F.col("modified_at").alias("source_modified_at"),
        ).alias("new"),
    )
    joined = sources.join(fresh, "doc_id", "full")
    hit = F.col("new").isNotNull()

    def updated(column: str) -> Column:
        return F.when(hit, F.col(f"new.{column}")).otherwise(F.col(column)).alias(column)

    def reset(column: str, kind: str) -> Column:
        return F.when(hit, F.lit(None).cast(kind)).otherwise(F.col(column)).alias(column)

    columns = [
        F.col("doc_id"),
        updated("title"),
        updated("correspondent"),
        updated("doc_date"),
        updated("source_modified_at"),
        reset("last_ingested_at", "timestamp_ntz"),
        F.when(hit, F.lit("RUNNING")).otherwise(F.col("status")).alias("status"),
        reset("error_message", "string"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    ]
    others = [c for c in sources.columns if c not in STATE_COLUMNS]
    return joined.select(*columns, *others)


def finish_ingest(sources: DataFrame, outcomes: DataFrame, as_of=None) -> DataFrame:
    """Set DONE, or ERROR with its message, for ``outcomes(doc_id, error)``."""
    now = moment(as_of)
    ended = outcomes.select("doc_id", F.col("error").alias("_error"), F.lit(True).alias("_ended"))
    hit = F.col("_ended").isNotNull()
    status = F.when(F.col("_error").isNull(), F.lit("DONE")).otherwise(F.lit("ERROR"))
    return (
        sources.join(ended, "doc_id", "left")
        .withColumns({
            "status": F.when(hit, status).otherwise(F.col("status")),
            "error_message": F.when(hit, F.col("_error")).otherwise(F.col("error_message")),
            "last_ingested_at": F.when(hit, now).otherwise(F.col("last_ingested_at")),
            "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
        })
        .drop("_error", "_ended")
    )


def without_documents(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """Chunks of other documents than the unique ``doc_ids``; safe for a document with very many."""
    gone = doc_ids.select("doc_id")
    return sizing.lookup_join(chunks, gone, "doc_id", "left_anti", spread="id", measure=True)


def replace_chunks(chunks: DataFrame, done_ids: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Drop every chunk of the done documents, then add their new ones."""
    return without_documents(chunks, done_ids).unionByName(new_chunks, allowMissingColumns=True)


def orphans(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """State rows whose document is gone."""
    return sources.join(documents.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def oldest_orphans(sources: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """State rows whose document is gone; with a ``limit`` the longest untouched, in their order."""
    gone = orphans(sources.select("doc_id", "updated_at"), documents)
    return gone if limit is None else top(gone, oldest_first("updated_at", "doc_id"), limit)


def cleanup(sources: DataFrame, chunks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State and chunks without those of deleted documents (delete with cascade)."""
    gone = orphans(sources.select("doc_id"), documents)
    kept = sources.join(gone, "doc_id", "left_anti")
    return kept, without_documents(chunks, gone)


def with_defaults(rows: DataFrame, start: Column | int = 0, as_of=None) -> DataFrame:
    """Fill what an insert may leave out: id, status, created_at and updated_at.

    Ids continue after ``start`` in document order.
    """
    now = moment(as_of)
    defaults = {"status": F.lit("PENDING"), "created_at": now, "updated_at": now}
    filled = rows.withColumns({
        name: F.coalesce(F.col(name), value) if name in rows.columns else value for name, value in defaults.items()
    })
    return sizing.dense_ids(filled, "doc_id", start)


def chunk_id(doc_id, chunk_index) -> Column:
    """Unique id from the natural key, equal on every retry; 31 bits hold the index."""
    doc_id = doc_id if isinstance(doc_id, Column) else F.col(doc_id)
    chunk_index = chunk_index if isinstance(chunk_index, Column) else F.col(chunk_index)
    return doc_id.cast("long") * F.lit(1 << 31) + chunk_index.cast("long")


def latest_versions(changes: DataFrame, key: str, version: str, *tie: str) -> DataFrame:
    """The newest row of each key; only one row per key and task is shuffled."""
    newest = F.max_by(F.struct(*changes.columns), F.struct(version, *tie))
    return changes.groupBy(key).agg(newest.alias("_row")).select("_row.*")
