"""Projections, filters, joins, aggregates, sorts and scalar functions of the document side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.functions import text
from folioseek.functions import vectors as vec
from folioseek.operators import aggregates, documents, search, sync
from folioseek.plans import sizing
from folioseek.plans.catalog_tables import text_of
from folioseek.plans.ordering import newest_first, oldest_first, top
from folioseek.plans.registry import query
from folioseek.plans.views import base, document_tables
from folioseek.sources.tables import join_path

LISTING_SQL = """id, title, CAST(document_date AS VARCHAR) AS document_date, CAST(modified_at AS VARCHAR) AS modified_at,
  mime_type, content, owner_username, note, correspondent_name, tags, source_url"""


def listing(view: DataFrame) -> DataFrame:
    """Document view rows with tags, dates and times as text."""
    return view.withColumns({
        "tags": F.array_join("tags", ","),
        "document_date": F.col("document_date").cast("string"),
        "modified_at": F.col("modified_at").cast("string"),
    })


# --- projections -----------------------------------------------------------------------


@query(
    "prj_1_column_projection",
    "SELECT id, title, CAST(created AS VARCHAR) AS created, mime_type FROM v_document",
    "v_document",
)
def _(spark, sf):
    return document_tables(spark, sf).documents.select("id", "title", *text_of("created"), "mime_type")


@query(
    "prj_2_alias_of_expression",
    "SELECT doc_id, length(text) AS text_length, upper(lang) AS language FROM documents",
)
def _(spark, sf):
    return base(spark, sf, "documents").select(
        "doc_id", F.length("text").cast("long").alias("text_length"), F.upper("lang").alias("language")
    )


@query(
    "prj_3_null_defaults",
    """SELECT d.id, coalesce(d.title, '(untitled)') AS title, coalesce(c.name, '') AS correspondent_name,
         coalesce(n.note, '(no note)') AS note, coalesce(array_to_string(t.tags, ','), '') AS tags
       FROM v_document d LEFT JOIN v_correspondent c ON d.correspondent_id = c.id
       LEFT JOIN v_note n ON n.id = d.id LEFT JOIN v_tags_of t ON t.id = d.id
       WHERE d.mime_type = 'application/pdf'""",
    "v_document v_correspondent v_note v_tags_of",
)
def _(spark, sf):
    view = documents.documents_view(document_tables(spark, sf), ordered=False)
    return view.select(
        "id",
        "title",
        text.or_empty("correspondent_name").alias("correspondent_name"),
        F.coalesce("note", F.lit(text.NO_NOTE)).alias("note"),
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    "prj_4_source_url",
    "SELECT id, concat('https://docs.example.com/documents/', CAST(id AS VARCHAR)) AS source_url FROM v_document",
    "v_document",
)
def _(spark, sf):
    docs = document_tables(spark, sf).documents
    return docs.select("id", text.document_url("id", "https://docs.example.com//").alias("source_url"))


# --- filters ---------------------------------------------------------------------------


@query(
    "flt_1_equality",
    "SELECT id, title FROM v_document WHERE mime_type = 'application/pdf'",
    "v_document",
)
def _(spark, sf):
    return document_tables(spark, sf).documents.filter(documents.is_pdf()).select("id", "title")


@query(
    "flt_2_condition_list",
    """SELECT doc_id, source FROM documents WHERE lang = 'en' AND n_chars > 1000 AND source <> 'src3'""",
)
def _(spark, sf):
    conditions = [F.col("lang") == "en", F.col("n_chars") > 1000, F.col("source") != "src3"]
    return base(spark, sf, "documents").filter(documents.all_of(conditions)).select("doc_id", "source")


@query(
    "flt_3_staleness",
    """SELECT d.id, s.status FROM v_document d LEFT JOIN v_source s ON d.id = s.doc_id
       WHERE d.mime_type = 'application/pdf'
         AND (s.doc_id IS NULL OR d.modified > s.last_ingested_at OR s.status = 'ERROR')""",
    "v_document v_source",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    state = t.sources.select(F.col("doc_id").alias("id"), "status", "last_ingested_at", F.lit(True).alias("_known"))
    docs = t.documents.filter(documents.is_pdf()).select("id", "modified")
    return docs.join(state, "id", "left").filter(sync.stale()).select("id", "status")


@query(
    "flt_4_ingested_only",
    "SELECT id, doc_id FROM v_searchable",
    "v_searchable",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    return search.searchable(t.chunks, t.sources).select("id", "doc_id")


@query(
    "flt_5_unmatched",
    "SELECT s.doc_id, s.title FROM v_source s LEFT JOIN v_document d ON s.doc_id = d.id WHERE d.id IS NULL",
    "v_source v_document",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    return sync.orphans(t.sources.select("doc_id", "title"), t.documents)


LOOKUP_REQUESTS = """CASE event_id % 8
  WHEN 0 THEN concat(' ', CAST(user_id AS VARCHAR(20)), ' ')
  WHEN 1 THEN concat(CAST(user_id AS VARCHAR(20)), '.5')
  WHEN 2 THEN event_type
  WHEN 3 THEN ''
  WHEN 4 THEN concat('+', CAST(user_id AS VARCHAR(20)))
  WHEN 5 THEN CAST(2147483640 + user_id AS VARCHAR(20))
  WHEN 6 THEN concat('-', CAST(user_id AS VARCHAR(20)))
  ELSE CAST(event_id AS VARCHAR(20)) END"""


@query(
    "flt_6_batch_lookup",
    f"""WITH r AS (SELECT event_id AS request_id, {LOOKUP_REQUESTS} AS id_text FROM events),
    p AS (SELECT *, CASE WHEN regexp_full_match(id_text, '[+-]?[0-9]+')
            THEN TRY_CAST(TRY_CAST(ltrim(id_text, '+') AS INT) AS BIGINT) END AS doc_id FROM r)
    SELECT p.request_id, p.id_text, coalesce(p.doc_id, -999) AS doc_id, d.title, CAST(d.document_date AS VARCHAR) AS document_date,
      CAST(d.modified_at AS VARCHAR) AS modified_at, d.mime_type, d.content, d.owner_username, d.note, d.correspondent_name, d.tags,
      d.source_url, CASE WHEN p.doc_id IS NULL THEN 'BAD_REQUEST' WHEN d.id IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status
    FROM p LEFT JOIN v_listing d ON p.doc_id = d.id""",
    "v_listing",
)
def _(spark, sf):
    requests = base(spark, sf, "events").selectExpr("event_id AS request_id", f"{LOOKUP_REQUESTS} AS id_text")
    answered = documents.lookup_documents(requests, document_tables(spark, sf))
    return answered.select(
        "request_id", "id_text", F.coalesce("doc_id", F.lit(-999).cast("long")).alias("doc_id"), "title",
        *text_of("document_date", "modified_at"), "mime_type", "content", "owner_username", "note", "correspondent_name",
        F.array_join("tags", ",").alias("tags"), "source_url", "status",
    )


SEARCH_REQUESTS = """conv_id * 100 + turn AS request_id,
  CASE WHEN role = 'system' OR turn = 6 THEN concat(' ', chr(9), chr(10)) ELSE concat(chr(10), text, '  ', chr(9)) END AS query,
  CASE turn WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN 21 ELSE CAST(conv_id % 25 AS INT) END AS top_k"""


@query(
    "flt_7_request_validation",
    f"""WITH r AS (SELECT {SEARCH_REQUESTS} FROM conversations),
    t AS (SELECT request_id, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS query, top_k FROM r)
    SELECT request_id, query, CAST(least(coalesce(CASE WHEN top_k > 0 THEN top_k END, 5), 20) AS INT) AS top_k,
      CASE WHEN query = '' THEN 'BAD_REQUEST' ELSE 'OK' END AS status FROM t""",
)
def _(spark, sf):
    return search.validate_requests(base(spark, sf, "conversations").selectExpr(*sql_items(SEARCH_REQUESTS)))


def sql_items(items: str) -> list[str]:
    """The request expressions, one per line group, as separate items."""
    first, second, third = items.split(",\n  CASE ")
    return [first, f"CASE {second}", f"CASE {third}"]


@query(
    "flt_8_exists_and_not_exists",
    """SELECT 'with chunks' AS kind, d.id FROM v_document d WHERE EXISTS (SELECT 1 FROM v_chunk k WHERE k.doc_id = d.id)
       UNION ALL SELECT 'without state', d.id FROM v_document d
       WHERE NOT EXISTS (SELECT 1 FROM v_source s WHERE s.doc_id = d.id)""",
    "v_document v_chunk v_source",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    ids = t.documents.select("id")
    with_chunks = ids.join(t.chunks.select(F.col("doc_id").alias("id")), "id", "left_semi")
    without_state = ids.join(t.sources.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return with_chunks.select(F.lit("with chunks").alias("kind"), "id").unionByName(
        without_state.select(F.lit("without state").alias("kind"), "id")
    )


# --- joins -----------------------------------------------------------------------------


@query(
    "jn_1_left_join_many_to_one",
    """SELECT d.id, u.username, c.name, n.note FROM v_document d LEFT JOIN v_user u ON d.owner_id = u.id
       LEFT JOIN v_correspondent c ON d.correspondent_id = c.id LEFT JOIN v_note n ON d.id = n.id""",
    "v_document v_user v_correspondent v_note",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    docs = t.documents.select("id", "owner_id", "correspondent_id")
    docs = sizing.lookup_join(docs, t.users.withColumnRenamed("id", "owner_id"), "owner_id", spread="id")
    names = t.correspondents.withColumnRenamed("id", "correspondent_id")
    docs = sizing.lookup_join(docs, names, "correspondent_id", spread="id")
    return docs.join(documents.notes_by_document(t.notes, "legacy"), "id", "left").select(
        "id", "username", "name", "note"
    )


@query(
    "jn_1_note_by_foreign_key",
    """SELECT DISTINCT d.id, n.note FROM v_document d LEFT JOIN v_note n ON n.document_id = d.id""",
    "v_document v_note",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    return t.documents.select("id").join(documents.notes_by_document(t.notes, "fk"), "id", "left")


@query(
    "jn_2_join_through_bridge",
    """SELECT d.id, coalesce(array_to_string(t.tags, ','), '') AS tags
       FROM v_document d LEFT JOIN v_tags_of t ON t.id = d.id""",
    "v_document v_tags_of",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    tags = documents.tags_per_document(t.document_tags, t.tags).withColumnRenamed("document_id", "id")
    return t.documents.select("id").join(tags, "id", "left").select(
        "id", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags")
    )


@query(
    "jn_3_documents_to_state",
    """SELECT d.id, s.status, CAST(s.last_ingested_at AS VARCHAR) AS last_ingested_at
       FROM v_document d LEFT JOIN v_source s ON d.id = s.doc_id""",
    "v_document v_source",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    state = t.sources.select(F.col("doc_id").alias("id"), "status", *text_of("last_ingested_at"))
    return t.documents.select("id").join(state, "id", "left")


@query(
    "jn_4_chunk_to_source",
    "SELECT k.id, k.content, s.title, s.status FROM v_chunk k JOIN v_source s ON k.doc_id = s.doc_id",
    "v_chunk v_source",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    state = t.sources.select("doc_id", "title", "status")
    joined = sizing.lookup_join(t.chunks.select("id", "doc_id", "content"), state, "doc_id", "inner", spread="id")
    return joined.select("id", "content", "title", "status")


@query(
    "jn_5_orphans",
    """SELECT doc_id, title, status FROM v_source s
       WHERE NOT EXISTS (SELECT 1 FROM v_document d WHERE d.id = s.doc_id)""",
    "v_source v_document",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    return sync.orphans(t.sources.select("doc_id", "title", "status"), t.documents)


@query(
    "jn_6_path_join",
    """SELECT d.id AS document_id, t.name AS tag_name FROM v_document d
       LEFT JOIN v_document_tag dt ON dt.document_id = d.id LEFT JOIN v_tag t ON t.id = dt.tag_id""",
    "v_document v_document_tag v_tag",
)
def _(spark, sf):
    joined = join_path(document_tables(spark, sf), "documents", "document_tags", "tag")
    return joined.select(F.col("documents_id").alias("document_id"), "tag_name")


@query(
    "jn_7_queries_against_chunks",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings),
    s AS (SELECT q.query_id, k.id, list_distance(k.v, q.q) AS score FROM q, v_searchable k),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s)
    SELECT query_id, id, round(score, 6) AS score FROM r WHERE rank <= 1""",
    "v_searchable",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    asked = base(spark, sf, "embeddings").selectExpr("vec_id AS query_id", "embedding AS q")
    found = search.exact_top_k(search.searchable(t.chunks, t.sources), asked, 1)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


# --- aggregates ------------------------------------------------------------------------


@query(
    "agg_1_tags_per_document",
    "SELECT id AS document_id, array_to_string(tags, ',') AS tags FROM v_tags_of",
    "v_tags_of",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    tags = documents.tags_per_document(t.document_tags, t.tags)
    return tags.select("document_id", F.array_join("tags", ",").alias("tags"))


@query(
    "agg_2_group_with_dependent_columns",
    """SELECT d.id, any_value(d.title) AS title, count(dt.tag_id) AS tag_count, u.username
       FROM v_document d LEFT JOIN v_user u ON d.owner_id = u.id
       LEFT JOIN v_document_tag dt ON dt.document_id = d.id GROUP BY d.id, u.username""",
    "v_document v_user v_document_tag",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    docs = t.documents.select("id", "title", "owner_id")
    owners = t.users.withColumnRenamed("id", "owner_id")
    counts = t.document_tags.groupBy(F.col("document_id").alias("id")).agg(F.count("tag_id").alias("tag_count"))
    return (
        sizing.lookup_join(docs, owners, "owner_id", spread="id")
        .join(counts, "id", "left")
        .select("id", "title", F.coalesce("tag_count", F.lit(0).cast("long")).alias("tag_count"), "username")
    )


@query(
    "agg_3_chunk_counts",
    "SELECT doc_id, count(*) AS chunks FROM v_chunk WHERE label <> 3 GROUP BY doc_id",
    "v_chunk",
)
def _(spark, sf):
    return aggregates.chunk_counts(document_tables(spark, sf).chunks, F.col("label") != 3)


# --- sorts, limits, windows ------------------------------------------------------------


@query(
    "srt_1_newest_first",
    """SELECT id, title, CAST(modified AS VARCHAR) AS modified FROM v_document ORDER BY v_document.modified DESC NULLS FIRST, id""",
    "v_document",
)
def _(spark, sf):
    ordered = document_tables(spark, sf).documents.orderBy(*newest_first("modified", "id"))
    return ordered.select("id", "title", *text_of("modified"))


@query(
    "srt_2_oldest_candidates",
    """SELECT doc_id, title, CAST(modified_at AS VARCHAR) AS modified_at FROM v_candidate
       ORDER BY modified_at, doc_id LIMIT 20""",
    "v_candidate",
)
def _(spark, sf):
    found = sync.ingest_candidates(document_tables(spark, sf), limit=sync.INGEST_BATCH)
    return found.select("doc_id", "title", *text_of("modified_at"))


@query(
    "srt_3_oldest_orphans",
    """SELECT doc_id, CAST(updated_at AS VARCHAR) AS updated_at FROM v_source
       WHERE doc_id NOT IN (SELECT id FROM v_document) ORDER BY updated_at, doc_id LIMIT 50""",
    "v_source v_document",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    return sync.oldest_orphans(t.sources, t.documents, sync.CLEANUP_BATCH).select("doc_id", *text_of("updated_at"))


@query(
    "srt_4_top_k_by_expression",
    """SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score
       FROM embeddings ORDER BY score, vec_id LIMIT 20""",
)
def _(spark, sf):
    emb = base(spark, sf, "embeddings")
    example = emb.filter(F.col("vec_id") == 7).select("embedding").scalar()
    scored = emb.withColumn("q", example).select(
        "vec_id", F.round(vec.l2_distance("embedding", "q"), 6).alias("score")
    )
    return top(scored, oldest_first("score", "vec_id"), 20)


@query(
    "srt_5_first_or_none",
    f"SELECT {LISTING_SQL} FROM v_listing WHERE id = 22",
    "v_listing",
)
def _(spark, sf):
    return listing(documents.find_document(document_tables(spark, sf), 22))


@query(
    "srt_6_first_chunk",
    """SELECT doc_id, arg_min(content, chunk_index) AS content FROM v_chunk GROUP BY doc_id""",
    "v_chunk",
)
def _(spark, sf):
    return aggregates.first_chunks(document_tables(spark, sf).chunks)


@query(
    "win_1_top_k_per_group",
    """WITH r AS (SELECT event_type, event_id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rank FROM events)
       SELECT event_type, event_id, value, rank FROM r WHERE rank <= 5""",
)
def _(spark, sf):
    scored = base(spark, sf, "events").selectExpr("event_type", "event_id AS id", "value AS score")
    best = search.per_query_top(scored, "event_type", 5)
    return best.select(
        "event_type", F.col("id").alias("event_id"), F.col("score").alias("value"), F.col("rank").cast("long").alias("rank")
    )


# --- scalar functions ------------------------------------------------------------------

# Fixed labels of the rendered text, as in the data model.
RENDER_SQL = """concat('Title: ', title, chr(10),
  CASE WHEN correspondent_name IS NULL THEN '' ELSE concat('Correspondent: ', correspondent_name, chr(10)) END,
  'Date: ', CAST(document_date AS VARCHAR), chr(10), chr(10), content, chr(10), chr(10),
  'Note: ', coalesce(note, '(no note)'), chr(10))"""


@query("scl_1_render_document", f"SELECT id, {RENDER_SQL} AS text FROM v_listing", "v_listing")
def _(spark, sf):
    view = documents.documents_view(document_tables(spark, sf), ordered=False)
    return view.select(
        "id",
        text.render_document("title", "correspondent_name", "document_date", "content", "note").alias("text"),
    )


@query("scl_2_join_list", "SELECT id, array_to_string(tags, ',') AS tags FROM v_tags_of", "v_tags_of")
def _(spark, sf):
    t = document_tables(spark, sf)
    tags = documents.tags_per_document(t.document_tags, t.tags)
    return tags.select(F.col("document_id").alias("id"), text.comma_joined("tags").alias("tags"))


@query(
    "scl_3_drop_nulls",
    """SELECT id, array_to_string(list_filter([title, CAST(owner_id AS VARCHAR), mime_type], lambda x: x IS NOT NULL), ',') AS parts
       FROM v_document""",
    "v_document",
)
def _(spark, sf):
    parts = F.array("title", F.col("owner_id").cast("string"), "mime_type")
    docs = document_tables(spark, sf).documents
    return docs.select("id", F.array_join(text.drop_nulls(parts), ",").alias("parts"))


@query(
    "scl_4_metadata_map",
    """SELECT id, to_json({'doc_id': CAST(id AS VARCHAR), 'title': title,
         'correspondent_name': coalesce(correspondent_name, ''), 'document_date': CAST(document_date AS VARCHAR),
         'owner_username': coalesce(owner_username, ''), 'tags': tags})::VARCHAR AS metadata, title FROM v_listing""",
    "v_listing",
)
def _(spark, sf):
    view = documents.documents_view(document_tables(spark, sf), ordered=False)
    entries = text.metadata_map("id", "title", "correspondent_name", "document_date", "owner_username", "tags")
    rows = view.select("id", entries.alias("entries"))
    return rows.select("id", F.to_json("entries").alias("metadata"), F.col("entries")["title"].alias("title"))


@query("scl_5_iso_date", "SELECT id, strftime(created, '%Y-%m-%d') AS day FROM v_document", "v_document")
def _(spark, sf):
    return document_tables(spark, sf).documents.select("id", text.iso_date("created").alias("day"))


@query(
    "scl_6_current_timestamp",
    "SELECT id, now()::TIMESTAMP >= modified AS after_change FROM v_document",
    "v_document",
)
def _(spark, sf):
    docs = document_tables(spark, sf).documents
    return docs.select("id", (sync.moment(None) >= F.col("modified")).alias("after_change"))


@query(
    "scl_7_trim_parse_clamp",
    """SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS trimmed,
         rtrim(concat(role, '///'), '/') AS stripped,
         coalesce(CASE WHEN regexp_full_match(split_part(text, ' ', 1), '[+-]?[0-9]+')
           THEN TRY_CAST(split_part(text, ' ', 1) AS INT) END, -1) AS number,
         CAST(least(turn, 3) AS INT) AS clamped
       FROM conversations""",
)
def _(spark, sf):
    return base(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        text.trimmed("text").alias("trimmed"),
        F.rtrim(F.concat("role", F.lit("///")), F.lit("/")).alias("stripped"),
        F.coalesce(text.to_int_or_null(F.split_part("text", F.lit(" "), F.lit(1))), F.lit(-1)).alias("number"),
        F.least("turn", F.lit(3)).cast("int").alias("clamped"),
    )


@query(
    "scl_8_status_text",
    "SELECT status, count(*) AS rows FROM v_source WHERE status IN ('PENDING', 'RUNNING', 'DONE', 'ERROR') GROUP BY 1",
    "v_source",
)
def _(spark, sf):
    sources = document_tables(spark, sf).sources
    return sources.filter(F.col("status").isin(*text.STATUSES)).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
