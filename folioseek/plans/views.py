"""Document-store tables derived from the test tables, as DataFrames and as SQL.

``SQL_VIEWS`` holds the same definitions for the oracle; ``with_views`` puts the needed ones
in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from folioseek.sources.tables import Tables

EXAMPLE = 7  # vec_id of the stored vector used as the example query
AS_OF = "2026-01-01 00:00:00"

SQL_VIEWS = {
    "v_user": "SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS username FROM nation",
    "v_correspondent": """
        SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, upper(source) AS name FROM documents""",
    "v_tag": """
        SELECT CAST(id AS BIGINT) AS id, name
        FROM (VALUES (1, 'de'), (2, 'fr'), (3, 'es'), (4, 'quality'), (5, 'toxic'), (6, 'unused')) AS t(id, name)""",
    "v_document_tag": """
        SELECT doc_id AS document_id, CAST(CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS BIGINT) AS tag_id
        FROM documents WHERE lang <> 'en'
        UNION ALL SELECT doc_id, 4 FROM labels WHERE quality = 1
        UNION ALL SELECT doc_id, 5 FROM labels WHERE toxic = 1""",
    "v_note": """
        SELECT item_id AS id, 3 * CAST(floor(item_id / 2.0) AS BIGINT) AS document_id, text AS note FROM benchmark""",
    "v_document": """
        SELECT doc_id AS id,
          CASE WHEN doc_id % 41 = 0 THEN NULL ELSE concat('Document ', CAST(doc_id AS VARCHAR(20))) END AS title,
          text AS content,
          CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(substr(source, 4) AS BIGINT) END AS correspondent_id,
          CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 25 END AS owner_id,
          CASE WHEN doc_id % 10 = 9 THEN 'image/png' ELSE 'application/pdf' END AS mime_type,
          DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS created,
          CAST('2024-01-01 00:00:00' AS TIMESTAMP) + ((doc_id * 37) % 43200) * INTERVAL '1' MINUTE AS modified,
          lang
        FROM documents""",
    "v_source": """
        SELECT d.id AS doc_id, coalesce(d.title, '(untitled)') AS title, coalesce(c.name, '') AS correspondent,
          d.created AS doc_date, d.modified AS source_modified_at,
          CASE WHEN d.id % 8 IN (1, 2) THEN NULL WHEN d.id % 5 = 0 THEN d.modified - INTERVAL '1' HOUR
               ELSE d.modified + INTERVAL '1' HOUR END AS last_ingested_at,
          CASE d.id % 8 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'PENDING' ELSE 'DONE' END AS status,
          CASE d.id % 8 WHEN 0 THEN 'failed before' END AS error_message,
          d.modified AS created_at, d.modified + INTERVAL '1' HOUR AS updated_at
        FROM v_document d LEFT JOIN v_correspondent c ON d.correspondent_id = c.id WHERE d.lang <> 'es'
        UNION ALL
        SELECT -1 - item_id, 'gone', '', DATE '2023-01-01', CAST('2023-01-01 00:00:00' AS TIMESTAMP),
          CAST('2023-01-02 00:00:00' AS TIMESTAMP), 'DONE', NULL, CAST('2023-01-02 00:00:00' AS TIMESTAMP),
          CAST('2023-01-02 00:00:00' AS TIMESTAMP) + item_id * INTERVAL '1' MINUTE
        FROM benchmark""",
    "v_chunk": """
        SELECT vec_id AS id,
          CASE WHEN label = 9 THEN -1 - CAST(floor(vec_id / 50.0) AS BIGINT)
               ELSE CAST(floor(vec_id / 3.0) AS BIGINT) END AS doc_id,
          CAST(CASE WHEN label = 9 THEN vec_id % 50 ELSE vec_id % 3 END AS INT) AS chunk_index,
          concat('chunk ', CAST(vec_id AS VARCHAR(20))) AS content, embedding, label
        FROM embeddings""",
    "v_tags_of": """
        SELECT dt.document_id AS id, list_sort(array_agg(t.name)) AS tags
        FROM v_document_tag dt JOIN v_tag t ON t.id = dt.tag_id GROUP BY dt.document_id""",
    "v_listing": """
        SELECT d.id, coalesce(d.title, '(untitled)') AS title, d.created AS document_date, d.modified AS modified_at,
          d.mime_type, d.content, u.username AS owner_username, n.note, c.name AS correspondent_name,
          coalesce(array_to_string(t.tags, ','), '') AS tags,
          concat('http://localhost:8000/documents/', CAST(d.id AS VARCHAR)) AS source_url
        FROM v_document d
        LEFT JOIN v_user u ON d.owner_id = u.id
        LEFT JOIN v_note n ON d.id = n.id
        LEFT JOIN v_correspondent c ON d.correspondent_id = c.id
        LEFT JOIN v_tags_of t ON d.id = t.id
        WHERE d.mime_type = 'application/pdf'""",
    "v_candidate": """
        SELECT d.id AS doc_id, coalesce(d.title, '(untitled)') AS title, coalesce(c.name, '') AS correspondent_name,
          d.modified AS modified_at, d.created AS created_at
        FROM v_document d
        LEFT JOIN v_correspondent c ON d.correspondent_id = c.id
        LEFT JOIN v_source s ON d.id = s.doc_id
        WHERE d.mime_type = 'application/pdf'
          AND (s.doc_id IS NULL OR d.modified > s.last_ingested_at OR s.status = 'ERROR')""",
    "v_searchable": """
        SELECT k.id, k.doc_id, k.content, k.embedding::DOUBLE[] AS v, s.title, s.correspondent
        FROM v_chunk k JOIN v_source s ON k.doc_id = s.doc_id WHERE s.status = 'DONE' AND k.embedding IS NOT NULL""",
}

NEEDS = {
    "v_source": ("v_document", "v_correspondent"),
    "v_tags_of": ("v_document_tag", "v_tag"),
    "v_listing": ("v_document", "v_user", "v_note", "v_correspondent", "v_tags_of"),
    "v_candidate": ("v_document", "v_correspondent", "v_source"),
    "v_searchable": ("v_chunk", "v_source"),
}


def with_views(body: str, *names: str) -> str:
    """``body`` behind the CTEs it needs, in dependency order."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, ()):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({SQL_VIEWS[name].strip()})" for name in ordered)
    body = body.strip()
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"


_schemas: dict[str, StructType] = {}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def document_columns(documents: DataFrame, *more: str) -> DataFrame:
    """``v_document`` of the documents table (batch or stream)."""
    start = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    return documents.selectExpr(
        "doc_id AS id",
        "CASE WHEN doc_id % 41 <> 0 THEN concat('Document ', CAST(doc_id AS STRING)) END AS title",
        "text AS content",
        "CASE WHEN doc_id % 7 <> 0 THEN CAST(substr(source, 4) AS BIGINT) END AS correspondent_id",
        "CASE WHEN doc_id % 11 <> 0 THEN doc_id % 25 END AS owner_id",
        "CASE WHEN doc_id % 10 = 9 THEN 'image/png' ELSE 'application/pdf' END AS mime_type",
        "date_add(DATE '2024-01-01', CAST(doc_id % 365 AS INT)) AS created",
        f"{start} + make_dt_interval(0, 0, CAST((doc_id * 37) % 43200 AS INT)) AS modified",
        "lang",
        "CAST(NULL AS TIMESTAMP_NTZ) AS deleted_at",
        *more,
    )


def document_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All derived tables over the parquet files in ``sf_dir``."""
    raw = base(spark, sf_dir, "documents")
    documents = document_columns(raw)
    benchmark = base(spark, sf_dir, "benchmark")
    labels = base(spark, sf_dir, "labels")
    correspondents = raw.selectExpr("CAST(substr(source, 4) AS BIGINT) AS id", "upper(source) AS name").distinct()
    tags = spark.sql(
        """SELECT CAST(id AS BIGINT) AS id, name
        FROM VALUES (1, 'de'), (2, 'fr'), (3, 'es'), (4, 'quality'), (5, 'toxic'), (6, 'unused') AS t(id, name)"""
    )
    document_tags = (
        raw.filter("lang <> 'en'")
        .selectExpr(
            "doc_id AS document_id",
            "CAST(CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS BIGINT) AS tag_id",
        )
        .unionByName(labels.filter("quality = 1").selectExpr("doc_id AS document_id", "4L AS tag_id"))
        .unionByName(labels.filter("toxic = 1").selectExpr("doc_id AS document_id", "5L AS tag_id"))
    )
    notes = benchmark.selectExpr(
        "item_id AS id", "3 * CAST(floor(item_id / 2.0D) AS BIGINT) AS document_id", "text AS note"
    )
    known = (
        document_columns(raw, "upper(source) AS correspondent_name")
        .filter("lang <> 'es'")
        .selectExpr(
            "id AS doc_id",
            "coalesce(title, '(untitled)') AS title",
            "CASE WHEN correspondent_id IS NULL THEN '' ELSE correspondent_name END AS correspondent",
            "created AS doc_date",
            "modified AS source_modified_at",
            """CASE WHEN id % 8 IN (1, 2) THEN NULL WHEN id % 5 = 0 THEN modified - make_dt_interval(0, 1)
                ELSE modified + make_dt_interval(0, 1) END AS last_ingested_at""",
            "CASE id % 8 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'PENDING' ELSE 'DONE' END AS status",
            "CASE id % 8 WHEN 0 THEN 'failed before' END AS error_message",
            "modified AS created_at",
            "modified + make_dt_interval(0, 1) AS updated_at",
        )
    )
    day = "TIMESTAMP_NTZ '2023-01-0{} 00:00:00'"
    gone = benchmark.selectExpr(
        "-1 - item_id AS doc_id",
        "'gone' AS title",
        "'' AS correspondent",
        "DATE '2023-01-01' AS doc_date",
        f"{day.format(1)} AS source_modified_at",
        f"{day.format(2)} AS last_ingested_at",
        "'DONE' AS status",
        "CAST(NULL AS STRING) AS error_message",
        f"{day.format(2)} AS created_at",
        f"{day.format(2)} + make_dt_interval(0, 0, CAST(item_id AS INT)) AS updated_at",
    )
    chunks = base(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS id",
        """CASE WHEN label = 9 THEN -1 - CAST(floor(vec_id / 50.0D) AS BIGINT)
           ELSE CAST(floor(vec_id / 3.0D) AS BIGINT) END AS doc_id""",
        "CAST(CASE WHEN label = 9 THEN vec_id % 50 ELSE vec_id % 3 END AS INT) AS chunk_index",
        "concat('chunk ', CAST(vec_id AS STRING)) AS content",
        "embedding",
        "label",
    )
    return Tables(
        documents=documents,
        users=base(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "lower(n_name) AS username"),
        notes=notes,
        correspondents=correspondents,
        document_tags=document_tags,
        tags=tags,
        sources=known.unionByName(gone),
        chunks=chunks,
    )
