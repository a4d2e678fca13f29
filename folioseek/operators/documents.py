"""The document view and lookups on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.functions import text
from folioseek.plans import sizing
from folioseek.plans.ordering import newest_first
from folioseek.sources.tables import Tables


def is_pdf() -> Column:
    return F.col("mime_type") == text.PDF_MIME


def all_of(conditions: list[Column]) -> Column:
    """AND over a condition list; true when it is empty."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def tags_per_document(document_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """``(document_id, tags)``: sorted tag names with repeats; missing names dropped.

    Equal (document, tag) rows are counted on the map side first, so the collected group is
    bounded by the number of different tags and not by the number of bridge rows.
    """
    counted = document_tags.groupBy("document_id", "tag_id").agg(F.count(F.lit(1)).alias("n"))
    names = tags.select(F.col("id").alias("tag_id"), "name").filter(F.col("name").isNotNull())
    named = sizing.lookup_join(counted, names, "tag_id", "inner")
    pairs = F.array_sort(F.collect_list(F.struct("name", "n")))
    repeated = F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["name"], p["n"].cast("int"))))
    return named.groupBy("document_id").agg(repeated.alias("tags"))


def notes_by_document(notes: DataFrame, note_join: str) -> DataFrame:
    """``(id, note)`` to join on the document id.

    ``legacy`` pairs a note with the document of the same id, as the source system's own
    listing does; ``fk`` follows the note's document reference (several rows per document);
    ``fk_first`` keeps only the note with the lowest id of each document.
    """
    if note_join == "legacy":
        return notes.select("id", "note")
    if note_join == "fk":
        return notes.select(F.col("document_id").alias("id"), "note").distinct()
    if note_join == "fk_first":
        first = notes.groupBy("document_id").agg(F.min_by("note", "id").alias("note"))
        return first.withColumnRenamed("document_id", "id")
    raise ValueError("note_join is 'legacy', 'fk' or 'fk_first'")


def documents_view(
    tables: Tables,
    conditions: list[Column] | None = None,
    only_ids: DataFrame | None = None,
    note_join: str = "legacy",
    exclude_soft_deleted: bool = False,
    base_url: str = text.DEFAULT_BASE_URL,
    ordered: bool = True,
) -> DataFrame:
    """PDF documents with owner, note, correspondent, tags and link, newest first.

    ``only_ids`` (one ``id`` column, unique) narrows documents and tags before any other work.
    """
    docs = tables.documents.filter(all_of([is_pdf(), *(conditions or [])]))
    if exclude_soft_deleted:
        docs = docs.filter(F.col("deleted_at").isNull())
    docs = docs.select("id", "title", "created", "modified", "mime_type", "content", "owner_id", "correspondent_id")
    bridge = tables.document_tags
    if only_ids is not None:
        docs = docs.join(only_ids, "id", "left_semi")
        bridge = bridge.join(only_ids.withColumnRenamed("id", "document_id"), "document_id", "left_semi")

    owners = tables.users.select(F.col("id").alias("owner_id"), F.col("username").alias("owner_username"))
    names = tables.correspondents.select(
        F.col("id").alias("correspondent_id"), F.col("name").alias("correspondent_name")
    )

    def described(df: DataFrame) -> DataFrame:
        df = sizing.lookup_join(df, owners, "owner_id", spread="id")
        return sizing.lookup_join(df, names, "correspondent_id", spread="id")

    if sizing.fits_broadcast(owners) and sizing.fits_broadcast(names):
        base = described(docs)
    else:
        # Big dimensions are joined to the narrow key columns; the text is shuffled once, by id.
        light = described(docs.select("id", "owner_id", "correspondent_id"))
        base = docs.join(light.select("id", "owner_username", "correspondent_name"), "id")

    tagged = tags_per_document(bridge, tables.tags).withColumnRenamed("document_id", "id")
    view = (
        base.join(notes_by_document(tables.notes, note_join), "id", "left")
        .join(tagged, "id", "left")
        .select(
            "id",
            text.or_untitled("title").alias("title"),
            F.col("created").alias("document_date"),
            F.col("modified").alias("modified_at"),
            "mime_type",
            "content",
            "owner_username",
            "note",
            "correspondent_name",
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
            text.document_url("id", base_url).alias("source_url"),
        )
    )
    return view.orderBy(*newest_first("modified_at", "id")) if ordered else view


def find_document(tables: Tables, doc_id: int, **options) -> DataFrame:
    """At most one row: the PDF document with this id."""
    return documents_view(tables, [F.col("id") == doc_id], **options).limit(1)


def lookup_documents(requests: DataFrame, tables: Tables, **options) -> DataFrame:
    """``(request_id, id_text)`` to one row each: OK with the whole document, BAD_REQUEST or NOT_FOUND.

    The document comes with every column of ``documents_view``, which ``options`` go to. Equal ids
    are looked up once and the answer goes back to all their requests, so a popular id costs one
    document row; the way back is salted past the broadcast bound.
    """
    parsed = requests.select("request_id", "id_text", text.to_int_or_null("id_text").cast("long").alias("doc_id"))
    wanted = parsed.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct()
    view = documents_view(tables, only_ids=wanted, ordered=False, **options)
    columns = [c for c in view.columns if c != "id"]
    answers = view.select(F.col("id").alias("doc_id"), *columns, F.lit(True).alias("_found"))
    joined = sizing.lookup_join(parsed, answers, "doc_id", spread="request_id")
    status = (
        F.when(F.col("doc_id").isNull(), "BAD_REQUEST").when(F.col("_found").isNull(), "NOT_FOUND").otherwise("OK")
    )
    return joined.select("request_id", "id_text", status.alias("status"), "doc_id", *columns)
