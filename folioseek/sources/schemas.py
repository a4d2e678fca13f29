"""Explicit schemas of the tables; a wider source table is pruned to these columns on read."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


VECTOR = T.ArrayType(T.FloatType())

SCHEMAS = {
    "documents": _schema(
        id=T.LongType(), title=T.StringType(), content=T.StringType(), modified=T.TimestampNTZType(),
        correspondent_id=T.LongType(), mime_type=T.StringType(), owner_id=T.LongType(), created=T.DateType(),
        deleted_at=T.TimestampNTZType(),
    ),
    "users": _schema(id=T.LongType(), username=T.StringType()),
    "notes": _schema(id=T.LongType(), note=T.StringType(), document_id=T.LongType()),
    "correspondents": _schema(id=T.LongType(), name=T.StringType()),
    "document_tags": _schema(id=T.LongType(), document_id=T.LongType(), tag_id=T.LongType()),
    "tags": _schema(id=T.LongType(), name=T.StringType()),
    "sources": _schema(
        id=T.LongType(), doc_id=T.LongType(), title=T.StringType(), correspondent=T.StringType(),
        doc_date=T.DateType(), source_modified_at=T.TimestampNTZType(), last_ingested_at=T.TimestampNTZType(),
        status=T.StringType(), error_message=T.StringType(), created_at=T.TimestampNTZType(),
        updated_at=T.TimestampNTZType(),
    ),
    "chunks": _schema(
        id=T.LongType(), doc_id=T.LongType(), chunk_index=T.IntegerType(), content=T.StringType(),
        embedding=VECTOR, metadata=T.StringType(), created_at=T.TimestampNTZType(),
    ),
}

# Foreign keys that joins may follow: path name -> (column here, other table, column there).
FOREIGN_KEYS = {
    "documents": {
        "owner": ("owner_id", "users", "id"),
        "correspondent": ("correspondent_id", "correspondents", "id"),
        "notes": ("id", "notes", "document_id"),
        "document_tags": ("id", "document_tags", "document_id"),
        "source": ("id", "sources", "doc_id"),
    },
    "document_tags": {"tag": ("tag_id", "tags", "id"), "document": ("document_id", "documents", "id")},
    "notes": {"document": ("document_id", "documents", "id")},
    "chunks": {"source": ("doc_id", "sources", "doc_id")},
    "sources": {"chunks": ("doc_id", "chunks", "doc_id"), "document": ("doc_id", "documents", "id")},
    "tags": {"document_tags": ("id", "document_tags", "tag_id")},
}
