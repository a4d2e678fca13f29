"""Chunking, embedding, ingestion, cleanup and streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.operators import chunking, documents, embedding, ingest, search, sync
from folioseek.operators.chunking import split_windows
from folioseek.plans import sizing
from folioseek.plans.catalog_documents import LISTING_SQL, RENDER_SQL, SEARCH_REQUESTS, listing, sql_items
from folioseek.plans.catalog_tables import text_of
from folioseek.plans.registry import query
from folioseek.plans.views import AS_OF, base, document_columns, document_tables
from folioseek.sources.store import ChunkStore
from folioseek.streaming import continuous

DIM = 64


def windows_sql(key: str, column: str, source: str) -> str:
    return f"""SELECT {key}, CAST(i AS INT) AS chunk_index, substring({column}, 1 + CAST(i AS INT) * 800, 1000) AS content
      FROM (SELECT {key}, {column}, unnest(generate_series(0, CAST(greatest(length({column}) - 201, 0) // 800 AS INT))) AS i
            FROM {source} WHERE length({column}) > 0)"""


def new_store(spark) -> ChunkStore:
    return ChunkStore(spark, sizing.work_path(spark, "store"))


# --- text ------------------------------------------------------------------------------


@query("txt_1_recursive_chunks")
def _(spark, sf):
    return chunking.chunk_documents(base(spark, sf, "documents")).select("doc_id", "chunk_index", "content")


@query(
    "txt_1_text_coverage",
    r"""SELECT doc_id, regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]', '', 'g') AS covered, true AS fits FROM documents
       WHERE regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]', '', 'g') <> ''""",
)
def _(spark, sf):
    def split(text: str) -> list[str]:
        return chunking.split_text(text, overlap=0)

    chunks = chunking.chunk_documents(base(spark, sf, "documents"), split)
    in_order = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    whole = F.array_join(F.transform(in_order, lambda c: c["content"]), "")
    return chunks.groupBy("doc_id").agg(
        F.regexp_replace(whole, r"[\s\x0b\x1c-\x1f\x85\p{Z}]", "").alias("covered"),
        (F.max(F.length("content")) <= chunking.CHUNK_SIZE).alias("fits"),
    )


@query("txt_2_window_chunks", windows_sql("doc_id", "text", "documents"))
def _(spark, sf):
    return chunking.window_chunks(base(spark, sf, "documents"))


@query(
    "txt_3_chunk_numbering",
    f"WITH k AS ({windows_sql('doc_id', 'text', 'documents')}) SELECT doc_id, count(*) AS chunks, max(chunk_index) AS last_index FROM k GROUP BY 1",
)
def _(spark, sf):
    chunks = chunking.chunk_documents(base(spark, sf, "documents"), split_windows)
    return chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max("chunk_index").alias("last_index")
    )


@query(
    "txt_4_batch_embedding",
    f"""WITH k AS ({windows_sql('doc_id', 'text', 'documents')})
    SELECT doc_id, chunk_index, CASE WHEN regexp_matches(content, '[\\p{{L}}\\p{{N}}]') THEN 1.0::DOUBLE ELSE 0.0 END AS norm, {DIM} AS dims FROM k""",
)
def _(spark, sf):
    from folioseek.functions.vectors import norm

    chunks = chunking.window_chunks(base(spark, sf, "documents"))
    embedded = embedding.hashing_embedder(DIM)(chunks, "content")
    return embedded.select(
        "doc_id", "chunk_index", F.round(norm("embedding"), 4).alias("norm"), F.size("embedding").alias("dims")
    )


@query("txt_4_embedding_vectors")
def _(spark, sf):
    chunks = chunking.window_chunks(base(spark, sf, "documents"))
    return embedding.hashing_embedder(DIM)(chunks, "content").select("doc_id", "chunk_index", "embedding")


@query(
    "txt_5_query_embedding",
    f"""WITH r AS (SELECT {SEARCH_REQUESTS} FROM conversations),
    t AS (SELECT request_id AS query_id, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS query, top_k FROM r)
    SELECT query_id, CAST(least(coalesce(CASE WHEN top_k > 0 THEN top_k END, 5), 20) AS INT) AS top_k,
      CASE WHEN regexp_matches(query, '[\\p{{L}}\\p{{N}}]') THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM t WHERE query <> ''""",
)
def _(spark, sf):
    from folioseek.functions.vectors import norm

    requests = search.validate_requests(base(spark, sf, "conversations").selectExpr(*sql_items(SEARCH_REQUESTS)))
    asked = embedding.embed_queries(requests, embedding.hashing_embedder(DIM))
    return asked.select("query_id", "top_k", F.round(norm("q"), 4).alias("norm"))


# --- ingestion -------------------------------------------------------------------------


@query("ing_1_documents_view", f"SELECT {LISTING_SQL} FROM v_listing", "v_listing")
def _(spark, sf):
    return listing(documents.documents_view(document_tables(spark, sf)))


@query(
    "ing_2_candidates",
    """SELECT doc_id, title, correspondent_name, CAST(modified_at AS VARCHAR) AS modified_at,
         CAST(created_at AS VARCHAR) AS created_at FROM v_candidate""",
    "v_candidate",
)
def _(spark, sf):
    due = sync.ingest_candidates(document_tables(spark, sf), limit=None)
    return due.select("doc_id", "title", "correspondent_name", *text_of("modified_at", "created_at"))


@query(
    "ing_3_status_transitions",
    f"""WITH merged AS (
      SELECT coalesce(s.doc_id, c.doc_id) AS doc_id,
        CASE WHEN c.doc_id IS NULL THEN s.status WHEN c.title = '(untitled)' THEN 'ERROR' ELSE 'DONE' END AS status,
        CASE WHEN c.doc_id IS NULL THEN s.error_message WHEN c.title = '(untitled)' THEN 'no title' END AS error_message,
        CASE WHEN c.doc_id IS NULL THEN s.last_ingested_at ELSE TIMESTAMP '{AS_OF}' END AS last_ingested_at
      FROM v_source s FULL JOIN v_candidate c ON s.doc_id = c.doc_id)
    SELECT doc_id, status, error_message, CAST(last_ingested_at AS VARCHAR) AS last_ingested_at FROM merged""",
    "v_source v_candidate",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    due = sync.ingest_candidates(t, limit=None)
    failed = due.select("doc_id", F.when(F.col("title") == "(untitled)", F.lit("no title")).alias("error"))
    ended = sync.finish_ingest(sync.begin_ingest(t.sources, due, AS_OF), failed, AS_OF)
    return ended.select("doc_id", "status", "error_message", *text_of("last_ingested_at"))


@query(
    "ing_4_fault_isolation",
    f"""WITH t AS (SELECT id, {RENDER_SQL} AS text FROM v_listing)
    SELECT id AS doc_id, CASE WHEN contains(text, ' und ') THEN 'ERROR' ELSE 'DONE' END AS status,
      CASE WHEN contains(text, ' und ') THEN 'cannot split' END AS error_message FROM t""",
    "v_listing",
)
def _(spark, sf):
    def fails_on_german(text: str) -> list[str]:
        if " und " in text:
            raise ValueError("cannot split")
        return split_windows(text)

    store = new_store(spark)
    ingest.ingest(document_tables(spark, sf), store, fails_on_german, embedding.hashing_embedder(DIM), AS_OF)
    return store.sources().select("doc_id", "status", "error_message")


@query(
    "ing_5_ingest_job",
    f"""WITH t AS (SELECT id AS doc_id, {RENDER_SQL} AS text FROM v_listing),
    k AS ({windows_sql('doc_id', 'text', 't')})
    SELECT doc_id * 2147483648 + chunk_index AS id, doc_id, chunk_index, content, {DIM} AS dims FROM k""",
    "v_listing",
)
def _(spark, sf):
    store = new_store(spark)
    ingest.ingest(document_tables(spark, sf), store, split_windows, embedding.hashing_embedder(DIM), AS_OF)
    return store.chunks().select("id", "doc_id", "chunk_index", "content", F.size("embedding").alias("dims"))


@query("ing_5_ingest_recursive_chunks")
def _(spark, sf):
    store = new_store(spark)
    ingest.ingest(document_tables(spark, sf), store, as_of=AS_OF)
    return store.chunks().select("id", "doc_id", "chunk_index", "content", "metadata")


@query(
    "ing_6_oldest_batch",
    """SELECT id AS doc_id, 'DONE' AS status, title FROM v_listing ORDER BY modified_at, id LIMIT 20""",
    "v_listing",
)
def _(spark, sf):
    store = new_store(spark)
    ingest.ingest(
        document_tables(spark, sf), store, split_windows, embedding.hashing_embedder(DIM), AS_OF, limit=sync.INGEST_BATCH
    )
    return store.sources().select("doc_id", "status", "title")


@query(
    "ing_6_drain",
    """SELECT id AS doc_id, 'DONE' AS status, title FROM v_listing""",
    "v_listing",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    store = new_store(spark)
    quarter = -(-t.documents.count() // 4)
    ingest.drain(t, store, quarter, splitter=split_windows, embedder=embedding.hashing_embedder(DIM), as_of=AS_OF)
    return store.sources().select("doc_id", "status", "title")


@query(
    "ing_7_orphan_cleanup",
    """SELECT k.id, k.doc_id, k.chunk_index FROM v_chunk k
       JOIN v_source s ON k.doc_id = s.doc_id JOIN v_document d ON d.id = k.doc_id""",
    "v_chunk v_source v_document",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    store = new_store(spark)
    store.write_chunks(0, t.chunks)
    store.commit(0, t.sources.withColumns({"chunk_run": F.lit(0), "deleted": F.lit(False)}))
    ingest.remove_orphans(t, store)
    return store.chunks().select("id", "doc_id", "chunk_index")


# --- streams ---------------------------------------------------------------------------


def streamed_documents(spark, sf) -> DataFrame:
    schema = base(spark, sf, "documents").schema
    return document_columns(continuous.document_stream(spark, f"{sf}/documents*.parquet", schema))


def run_stream(spark, sf, store: ChunkStore, tables, documents=None, **options) -> None:
    query = continuous.start_ingest(
        documents or streamed_documents(spark, sf), tables, store, sizing.work_path(spark, "stream"),
        trigger={"availableNow": True}, splitter=split_windows, embedder=embedding.hashing_embedder(DIM), as_of=AS_OF,
        **options,
    )
    query.awaitTermination()


@query(
    "str_1_continuous_ingest",
    f"""WITH t AS (SELECT id AS doc_id, {RENDER_SQL} AS text FROM v_listing),
    k AS ({windows_sql('doc_id', 'text', 't')}) SELECT doc_id, count(*) AS chunks FROM k GROUP BY doc_id""",
    "v_listing",
)
def _(spark, sf):
    store = new_store(spark)
    run_stream(spark, sf, store, lambda: document_tables(spark, sf))
    return store.chunks().groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


@query(
    "str_2_continuous_cleanup",
    """SELECT id AS doc_id, title FROM v_listing WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = id)""",
    "v_listing",
)
def _(spark, sf):
    store = new_store(spark)

    def left_over():
        # Only labelled documents still exist when the cleanup looks.
        t = document_tables(spark, sf)
        labelled = base(spark, sf, "labels").select(F.col("doc_id").alias("id"))
        return type(t)(**{**t.__dict__, "documents": t.documents.join(labelled, "id", "left_semi")})

    run_stream(spark, sf, store, left_over, cleanup_every=1)
    return store.sources().select("doc_id", "title")


@query(
    "str_1_edit_before_ingest_clock",
    f"""WITH t AS (SELECT id AS doc_id, {RENDER_SQL} AS text FROM v_listing),
    k AS ({windows_sql('doc_id', 'text', 't')}) SELECT doc_id, chunk_index, content FROM k""",
    "v_listing",
)
def _(spark, sf):
    # Every document was ingested in an older version, by a clock later than the edits that now arrive.
    t = document_tables(spark, sf)
    older = t.documents.withColumns({"content": F.lit("old"), "modified": F.col("modified") - F.expr("INTERVAL 1 HOUR")})
    store = new_store(spark)
    ingest.ingest(replace(t, documents=older), store, split_windows, embedding.hashing_embedder(DIM), AS_OF)
    run_stream(spark, sf, store, lambda: t)
    return store.chunks().select("doc_id", "chunk_index", "content")


@query(
    "str_1_retry_after_failure",
    """SELECT id AS doc_id, 'DONE' AS status, CAST(NULL AS VARCHAR) AS error_message FROM v_listing""",
    "v_listing",
)
def _(spark, sf):
    # The model was down for all but English documents; only English ones arrive after that.
    t = document_tables(spark, sf)

    def fails(text: str) -> list[str]:
        if " the " not in text:
            raise ValueError("model is down")
        return split_windows(text)

    store = new_store(spark)
    ingest.ingest(t, store, fails, embedding.hashing_embedder(DIM), AS_OF)
    run_stream(spark, sf, store, lambda: t, streamed_documents(spark, sf).filter("lang = 'en'"))
    return store.sources().select("doc_id", "status", "error_message")


@query(
    "str_2_cleanup_without_arrivals",
    """SELECT id AS doc_id, title FROM v_listing WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = id)""",
    "v_listing",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    store = new_store(spark)
    ingest.ingest(t, store, split_windows, embedding.hashing_embedder(DIM), AS_OF)
    labelled = base(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    left = replace(t, documents=t.documents.join(labelled, "id", "left_semi"))
    continuous.start_cleanup(
        spark, lambda: left, store, sizing.work_path(spark, "cleanup"), {"availableNow": True}
    ).awaitTermination()
    return store.sources().select("doc_id", "title")


@query(
    "str_3_latest_version",
    """SELECT user_id, event_id, CAST(ts AS VARCHAR) AS ts, event_type FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(spark, sf):
    changes = base(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    newest = sync.latest_versions(changes, "user_id", "ts", "event_id")
    return newest.select("user_id", "event_id", *text_of("ts"), "event_type")


# --- pluggable parts -------------------------------------------------------------------


@query(
    "udf_1_vector_column",
    "SELECT vec_id, CAST(len(embedding) AS INT) AS dims, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings",
)
def _(spark, sf):
    from folioseek.sources import vector_text

    rows = base(spark, sf, "embeddings").select("vec_id", vector_text.encode("embedding").alias("v"))
    decoded, _ = vector_text.decode(rows, "v")
    return decoded.select(
        "vec_id", F.size("embedding").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first")
    )


@query("udf_2_pluggable_splitter", windows_sql("doc_id", "text", "documents"))
def _(spark, sf):
    chunks = chunking.chunk_documents(base(spark, sf, "documents"), split_windows)
    return chunks.select("doc_id", "chunk_index", "content")


def letter_model():
    """A model that SQL can express: length, and number of vowels."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(sum(t.count(v) for v in "aeiou"))] for t in texts]

    return embed


def letters_sql(column: str) -> str:
    return f"""[length({column})::DOUBLE, (length({column}) - length(regexp_replace({column}, '[aeiou]', '', 'g')))::DOUBLE]"""


@query(
    "knn_1_text_question",
    f"""WITH t AS (SELECT id AS doc_id, {RENDER_SQL} AS text FROM v_listing),
    k AS ({windows_sql('doc_id', 'text', 't')}),
    c AS (SELECT doc_id * 2147483648 + chunk_index AS id, doc_id, content, {letters_sql('content')} AS v FROM k),
    r AS (SELECT conv_id * 100 + turn AS query_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS query,
        least(CASE WHEN turn > 0 THEN turn ELSE 5 END, 20) AS top_k FROM conversations),
    q AS (SELECT query_id, top_k, {letters_sql('query')} AS v FROM r WHERE query <> ''),
    s AS (SELECT query_id, top_k, id, c.doc_id, list_distance(q.v, c.v) AS score FROM q, c),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s)
    SELECT query_id, rank, h.id, l.title, round(score, 6) AS score, l.source_url
    FROM h JOIN v_listing l ON l.id = h.doc_id WHERE rank <= top_k""",
    "v_listing",
)
def _(spark, sf):
    # Every turn of every conversation asks: validate, embed, search, shape.
    embedder = embedding.model_embedder(letter_model, dim=2, spread=())
    store = new_store(spark)
    ingest.ingest(document_tables(spark, sf), store, split_windows, embedder, AS_OF)
    asked = base(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"), F.col("text").alias("query"), F.col("turn").alias("top_k")
    )
    queries = embedding.embed_queries(search.validate_requests(asked), embedder)
    hits = search.search_store(store, queries)
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id", "title", F.round("score", 6).alias("score"), "source_url"
    )


@query(
    "udf_3_pluggable_model",
    """SELECT doc_id, length(text)::DOUBLE AS length, (length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')))::DOUBLE AS vowels
       FROM documents""",
)
def _(spark, sf):
    embedder = embedding.model_embedder(letter_model, dim=2, spread=("doc_id",))
    embedded = embedder(base(spark, sf, "documents").select("doc_id", "text"), "text")
    vector = F.col("embedding")
    return embedded.select("doc_id", vector[0].cast("double").alias("length"), vector[1].cast("double").alias("vowels"))
