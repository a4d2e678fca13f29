"""Scans, sinks and constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.operators import documents, quality, sync
from folioseek.plans import sizing
from folioseek.plans.registry import query
from folioseek.plans.views import AS_OF, base, document_tables
from folioseek.sources import json_sink, vector_text
from folioseek.sources.store import ChunkStore


def text_of(*columns: str):
    """Times and dates as text, so that both engines print them alike."""
    return [F.col(c).cast("string").alias(c) for c in columns]


STATE_COLUMNS = ("doc_id", "title", "correspondent", "status")
STATE_TIMES = ("doc_date", "source_modified_at", "last_ingested_at", "error_message", "created_at", "updated_at")
STATE_SQL = """doc_id, title, correspondent, status, CAST(doc_date AS VARCHAR) AS doc_date,
  CAST(source_modified_at AS VARCHAR) AS source_modified_at, CAST(last_ingested_at AS VARCHAR) AS last_ingested_at,
  error_message, CAST(created_at AS VARCHAR) AS created_at, CAST(updated_at AS VARCHAR) AS updated_at"""


def state_rows(df: DataFrame) -> DataFrame:
    return df.select(*STATE_COLUMNS, *text_of(*STATE_TIMES))


@query(
    "src_1_table_scan",
    "SELECT doc_id, lang, source, n_chars FROM documents",
)
def _(spark, sf):
    return base(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query(
    "src_2_rows_by_unique_key",
    f"SELECT {STATE_SQL} FROM v_source WHERE doc_id IN (SELECT doc_id FROM v_candidate)",
    "v_source v_candidate",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    wanted = sync.ingest_candidates(t, limit=None).select("doc_id")
    return state_rows(t.sources.join(wanted, "doc_id", "left_semi"))


VECTOR_TEXT = """CASE WHEN l_returnflag = 'R' THEN NULL
  WHEN l_linenumber = 7 THEN concat('[', l_returnflag, ']')
  WHEN l_linenumber = 6 THEN '[]'
  ELSE concat('[', CAST(l_linenumber AS VARCHAR(9)), ', ', CAST(l_partkey AS VARCHAR(20)), ',-',
              CAST(l_suppkey AS VARCHAR(20)), 'e-2]') END"""


@query(
    "src_3_decode_vector_text",
    f"""WITH t AS (SELECT l_orderkey, {VECTOR_TEXT} AS v FROM lineitem),
    p AS (SELECT l_orderkey, v, [TRY_CAST(trim(x) AS FLOAT) FOR x IN string_split(regexp_replace(v, '^\\[|\\]$', '', 'g'), ',')] AS e
          FROM t)
    SELECT l_orderkey, CAST(coalesce(len(e), 0) AS INT) AS dims,
           round(coalesce(list_sum(e::DOUBLE[]), 0.0), 3) AS total
    FROM p WHERE v IS NULL OR len(list_filter(e, lambda x: x IS NULL)) = 0""",
)
def _(spark, sf):
    rows = base(spark, sf, "lineitem").selectExpr("l_orderkey", f"{VECTOR_TEXT} AS v")
    decoded, _ = vector_text.decode(rows, "v")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return decoded.select("l_orderkey", F.size("embedding").alias("dims"), F.round(total, 3).alias("total"))


@query(
    "src_3_decode_rejects",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, {VECTOR_TEXT} AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, v FROM t
    WHERE v IS NOT NULL AND len(list_filter(string_split(regexp_replace(v, '^\\[|\\]$', '', 'g'), ','),
          lambda x: TRY_CAST(trim(x) AS FLOAT) IS NULL)) > 0""",
)
def _(spark, sf):
    rows = base(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{VECTOR_TEXT} AS v")
    return vector_text.decode(rows, "v")[1]


@query(
    "snk_1_encode_vector_text",
    """SELECT l_orderkey, l_linenumber,
       concat('[', CAST(l_linenumber::FLOAT AS VARCHAR), ', ', CAST(l_quantity::FLOAT AS VARCHAR), ']') AS v
       FROM lineitem""",
)
def _(spark, sf):
    vector = F.array(F.col("l_linenumber").cast("float"), F.col("l_quantity").cast("float"))
    return base(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", vector_text.encode(vector).alias("v"))


@query(
    "snk_2_insert_chunks",
    """SELECT k.id, k.doc_id, k.chunk_index, k.content, round(list_sum(k.embedding::DOUBLE[]), 5) AS mass
       FROM v_chunk k JOIN v_source s ON k.doc_id = s.doc_id""",
    "v_chunk v_source",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    store = ChunkStore(spark, sizing.work_path(spark, "insert"))
    store.write_chunks(0, t.chunks)
    store.commit(0, t.sources.withColumns({"chunk_run": F.lit(0), "deleted": F.lit(False)}))
    mass = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return store.chunks().select("id", "doc_id", "chunk_index", "content", F.round(mass, 5).alias("mass"))


@query(
    "snk_3_upsert_state",
    f"""WITH merged AS (
      SELECT coalesce(s.doc_id, c.doc_id) AS doc_id,
        CASE WHEN c.doc_id IS NULL THEN s.title ELSE c.title END AS title,
        CASE WHEN c.doc_id IS NULL THEN s.correspondent ELSE c.correspondent_name END AS correspondent,
        CASE WHEN c.doc_id IS NULL THEN s.doc_date ELSE c.created_at END AS doc_date,
        CASE WHEN c.doc_id IS NULL THEN s.source_modified_at ELSE c.modified_at END AS source_modified_at,
        CASE WHEN c.doc_id IS NULL THEN s.last_ingested_at END AS last_ingested_at,
        CASE WHEN c.doc_id IS NULL THEN s.status ELSE 'RUNNING' END AS status,
        CASE WHEN c.doc_id IS NULL THEN s.error_message END AS error_message,
        coalesce(s.created_at, TIMESTAMP '{AS_OF}') AS created_at,
        CASE WHEN c.doc_id IS NULL THEN s.updated_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at
      FROM v_source s FULL JOIN v_candidate c ON s.doc_id = c.doc_id)
    SELECT {STATE_SQL} FROM merged""",
    "v_source v_candidate",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    return state_rows(sync.begin_ingest(t.sources, sync.ingest_candidates(t, limit=None), AS_OF))


OUTCOME_SQL = "SELECT doc_id, CASE WHEN title = '(untitled)' THEN 'no title' END AS error FROM v_candidate"


def untitled_fails(candidates: DataFrame) -> DataFrame:
    return candidates.select("doc_id", F.when(F.col("title") == "(untitled)", F.lit("no title")).alias("error"))


@query(
    "snk_4_update_by_key",
    f"""WITH o AS ({OUTCOME_SQL}), merged AS (
      SELECT s.doc_id, s.title, s.correspondent, s.doc_date, s.source_modified_at, s.created_at,
        CASE WHEN o.doc_id IS NULL THEN s.status WHEN o.error IS NULL THEN 'DONE' ELSE 'ERROR' END AS status,
        CASE WHEN o.doc_id IS NULL THEN s.error_message ELSE o.error END AS error_message,
        CASE WHEN o.doc_id IS NULL THEN s.last_ingested_at ELSE TIMESTAMP '{AS_OF}' END AS last_ingested_at,
        CASE WHEN o.doc_id IS NULL THEN s.updated_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at
      FROM v_source s LEFT JOIN o ON s.doc_id = o.doc_id)
    SELECT {STATE_SQL} FROM merged""",
    "v_source v_candidate",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    return state_rows(sync.finish_ingest(t.sources, untitled_fails(sync.ingest_candidates(t, limit=None)), AS_OF))


@query(
    "snk_5_replace_chunks",
    """SELECT id, doc_id, chunk_index, content FROM v_chunk WHERE doc_id NOT IN (SELECT doc_id FROM v_candidate)
       UNION ALL SELECT doc_id * 2147483648, doc_id, 0, title FROM v_candidate""",
    "v_chunk v_candidate",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    due = sync.ingest_candidates(t, limit=None)
    fresh = due.select(
        sync.chunk_id("doc_id", F.lit(0)).alias("id"), "doc_id", F.lit(0).alias("chunk_index"),
        F.col("title").alias("content"),
    )
    old = t.chunks.select("id", "doc_id", "chunk_index", "content")
    return sync.replace_chunks(old, due.select("doc_id"), fresh)


@query(
    "snk_6_delete_with_cascade",
    """SELECT 'source' AS kind, doc_id AS id FROM v_source WHERE doc_id IN (SELECT id FROM v_document)
       UNION ALL SELECT 'chunk', id FROM v_chunk
       WHERE doc_id NOT IN (SELECT doc_id FROM v_source WHERE doc_id NOT IN (SELECT id FROM v_document))""",
    "v_source v_chunk",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    sources, chunks = sync.cleanup(t.sources, t.chunks, t.documents)
    return sources.select(F.lit("source").alias("kind"), F.col("doc_id").alias("id")).unionByName(
        chunks.select(F.lit("chunk").alias("kind"), "id")
    )


@query(
    "snk_7_json_documents",
    """SELECT to_json({'id': id, 'title': title, 'document_date': CAST(document_date AS VARCHAR),
         'modified_at': CAST(modified_at AS VARCHAR), 'mime_type': mime_type,
         'content': content, 'owner_username': owner_username, 'note': note,
         'correspondent_name': correspondent_name,
         'tags': CASE WHEN tags = '' THEN [] ELSE string_split(tags, ',') END, 'source_url': source_url})::VARCHAR AS json
       FROM v_listing""",
    "v_listing",
)
def _(spark, sf):
    view = documents.documents_view(document_tables(spark, sf), ordered=False)
    return json_sink.to_json_rows(
        view.withColumns({c: F.col(c).cast("string") for c in ("document_date", "modified_at")})
    )


@query(
    "snk_8_insert_defaults",
    f"""SELECT c.doc_id, c.title, coalesce(s.status, 'PENDING') AS status,
         CAST(coalesce(s.created_at, TIMESTAMP '{AS_OF}') AS VARCHAR) AS created_at,
         CAST(coalesce(s.updated_at, TIMESTAMP '{AS_OF}') AS VARCHAR) AS updated_at,
         (SELECT count(*) FROM v_source) + row_number() OVER (ORDER BY c.doc_id) AS id
       FROM v_candidate c LEFT JOIN v_source s ON c.doc_id = s.doc_id""",
    "v_candidate v_source",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    due = sync.ingest_candidates(t, limit=None).select("doc_id", "title")
    partial = due.join(t.sources.select("doc_id", "status", "created_at", "updated_at"), "doc_id", "left")
    start = t.sources.agg(F.count(F.lit(1))).scalar()
    filled = sync.with_defaults(partial, start, AS_OF)
    return filled.select("doc_id", "title", "status", *text_of("created_at", "updated_at"), "id")


@query(
    "dq_1_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(spark, sf):
    return quality.duplicate_keys(base(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "dq_1_duplicate_chunk_positions",
    "SELECT doc_id, chunk_index, count(*) AS copies FROM v_chunk GROUP BY 1, 2 HAVING count(*) > 1",
    "v_chunk",
)
def _(spark, sf):
    return quality.duplicate_keys(document_tables(spark, sf).chunks, "doc_id", "chunk_index")


@query(
    "dq_2_chunks_without_source",
    """SELECT doc_id, count(*) AS rows FROM v_chunk WHERE doc_id NOT IN (SELECT doc_id FROM v_source) GROUP BY 1""",
    "v_chunk v_source",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    return quality.missing_parents(t.chunks, "doc_id", t.sources, "doc_id")


@query(
    "dq_3_rule_violations",
    """SELECT 'title not null' AS rule, count(*) FILTER (title IS NULL) AS violations FROM v_document
       UNION ALL SELECT 'owner_id not null', count(*) FILTER (owner_id IS NULL) FROM v_document
       UNION ALL SELECT 'mime_type allowed', count(*) FILTER (mime_type <> 'application/pdf') FROM v_document
       UNION ALL SELECT 'content length', count(*) FILTER (length(content) < 100) FROM v_document
       UNION ALL SELECT 'status allowed', count(*) FILTER (status NOT IN ('RUNNING', 'DONE', 'ERROR')) FROM v_source""",
    "v_document v_source",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    rules = {
        **quality.not_null("title", "owner_id"),
        **quality.allowed("mime_type", ("application/pdf",)),
        "content length": F.length("content") >= 100,
    }
    states = quality.allowed("status", ("RUNNING", "DONE", "ERROR"))
    return quality.rule_violations(t.documents, rules).unionByName(quality.rule_violations(t.sources, states))


@query(
    "dq_4_dimension_summary",
    "SELECT CAST(len(embedding) AS INT) AS dims, count(*) AS rows FROM embeddings GROUP BY 1",
)
def _(spark, sf):
    return quality.dimension_summary(base(spark, sf, "embeddings"), "embedding")


@query(
    "dq_4_wrong_dimensions",
    """SELECT vec_id, CAST(len(embedding) AS INT) AS dims FROM embeddings WHERE len(embedding) <> 384""",
)
def _(spark, sf):
    bad = quality.wrong_dimensions(base(spark, sf, "embeddings"), "embedding", 384)
    return bad.select("vec_id", F.size("embedding").alias("dims"))


@query(
    "dq_5_embedding_counts",
    """WITH k AS (SELECT doc_id, CASE WHEN label <> 3 THEN embedding END AS e FROM v_chunk)
       SELECT doc_id, count(*) AS segments, count(e) AS embeddings,
         CASE WHEN count(e) <> count(*) THEN concat(count(e), ' vectors for ', count(*), ' segments')
         END AS error FROM k GROUP BY doc_id""",
    "v_chunk",
)
def _(spark, sf):
    chunks = document_tables(spark, sf).chunks
    return quality.embedding_counts(
        chunks.withColumn("embedding", F.when(F.col("label") != 3, F.col("embedding")))
    )
