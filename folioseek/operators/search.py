"""Nearest-neighbour search over chunk embeddings.

``score`` is a distance: the smallest is the best hit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioseek.functions import bits, text
from folioseek.operators import blocks, query_blocks
from folioseek.plans import sizing
from folioseek.plans.shipping import ship_package
from folioseek.sources.store import ChunkStore
from folioseek.plans.ordering import oldest_first

DEFAULT_TOP_K = 5
MAX_TOP_K = 20
FEW_QUERIES = 256
HIT_BYTES = 64
SNIPPET_BYTES = 8192
#: Hits that a task holds at most for queries that were sent to it; past it queries are stored as blocks.
STATE_BYTES = 64 * 1024 * 1024
#: Queries and hits that are always sent to the rows. Past it the rows are stored and led past the queries, unless they
#: take more than ``ROWS_PER_QUERY`` times the bytes of the queries and their hits.
SENT_BYTES = 1024 * 1024
ROWS_PER_QUERY = 64
#: Tasks whose hits are merged together before those of all tasks are.
FAN_IN = 256


def validate_requests(requests: DataFrame) -> DataFrame:
    """``(request_id, query, top_k)`` to trimmed query, effective top_k and status."""
    query = text.trimmed("query")
    return requests.select(
        "request_id",
        query.alias("query"),
        text.clamped_top_k("top_k", DEFAULT_TOP_K, MAX_TOP_K).cast("int").alias("top_k"),
        F.when(F.coalesce(query, F.lit("")) == "", F.lit("BAD_REQUEST")).otherwise(F.lit("OK")).alias("status"),
    )


def searchable(
    chunks: DataFrame, sources: DataFrame, *columns: str, limit: int = sizing.BROADCAST_BYTES
) -> DataFrame:
    """Embedded chunks whose document is ingested (status DONE).

    The smaller of two sets of ids is broadcast: the ingested documents, or those that have
    chunks and are not ingested. Only if neither fits ``limit`` are the chunks shuffled.
    """
    done = sources.filter(F.col("status") == "DONE").select("doc_id")
    kept = chunks.filter(F.col("embedding").isNotNull()).select("id", "doc_id", "embedding", *columns)
    if not sizing.fits_broadcast(done, limit, measure=True):
        others = chunks.select("doc_id").distinct().join(done, "doc_id", "left_anti")
        if sizing.fits_broadcast(others, limit, measure=True):
            known = kept.filter(F.col("doc_id").isNotNull())
            return known.join(F.broadcast(others), "doc_id", "left_anti").select(*kept.columns)
    return sizing.lookup_join(kept, done, "doc_id", "left_semi", limit, spread="id", measure=True)


def per_query_top(scored: DataFrame, query: str, k: Column | int, fan_in: int | None = None) -> DataFrame:
    """The ``k`` smallest scores of each query; Spark trims every task before the shuffle.

    With ``fan_in`` the hits of so many tasks are merged first, and what is left of them per query, so
    that no task receives the hits of all tasks for one query. ``scored`` must not be shuffled yet.
    """
    order = oldest_first("score", "id")
    if fan_in is not None:
        scored = scored.withColumn("_group", F.floor(F.spark_partition_id() / fan_in))
        first = F.row_number().over(Window.partitionBy(query, "_group").orderBy(*order))
        scored = scored.withColumn("_place", first).filter(F.col("_place") <= k).drop("_place", "_group")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def many_tasks(vectors: DataFrame) -> int | None:
    """``FAN_IN`` where reading ``vectors`` takes more tasks than that, by their estimated size."""
    split = int(vectors.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return FAN_IN if sizing.estimated_bytes(vectors) > FAN_IN * split else None


def query_block(rows: pa.Table, k: int, metric: str) -> blocks.QueryBlock:
    ids = rows.column("query_id").to_numpy().astype("int64")
    return blocks.QueryBlock(ids, blocks.rows_of(rows.column("q"), metric), k, metric)


def _arrow_batches(batches: Iterator[pa.RecordBatch], block: blocks.QueryBlock):
    width = block.vectors.shape[1]
    for batch in batches:
        if batch.num_rows:
            rows = blocks.rows_of(batch.column("embedding"), block.metric, width)
            yield batch.column("id").to_numpy(zero_copy_only=False), rows


def by_grid(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str, cell_bytes: int, on: str | None = None
) -> DataFrame:
    """Both sides cut into hash blocks of about ``cell_bytes``; a cell meets one of each.

    Rows repeat once per query block and queries once per row block; a cell emits at most
    ``k`` rows per query. With ``on``, a column of both sides, only equal values meet, and
    each value is cut by its own size, so a hot value becomes many cells. This is the way for
    shared folders that tasks cannot open themselves; otherwise queries are stored as blocks.
    """
    ship_package(vectors.sparkSession)

    def block_count(column: str) -> Column:
        size = F.coalesce(F.sum(F.size(column).cast("long") * 8), F.lit(0))
        return F.greatest(F.lit(1), F.ceil(size / F.lit(cell_bytes))).cast("int")

    def sized(df: DataFrame) -> DataFrame:
        """``df`` with the block counts of both sides for its value of ``on``."""
        if on is None:
            return df.withColumns({"rbs": F.lit(row_blocks), "qbs": F.lit(query_blocks)})
        return df.join(F.broadcast(counts) if sizing.fits_broadcast(counts, measure=True) else counts, on)

    if on is None:
        row_blocks = vectors.agg(block_count("embedding")).first()[0]
        query_blocks = queries.agg(block_count("q")).first()[0]
    else:
        counts = vectors.groupBy(on).agg(block_count("embedding").alias("rbs")).join(
            queries.groupBy(on).agg(block_count("q").alias("qbs")), on
        )

    def block(key: str, count: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    keys = [*([on] if on else []), "rb", "qb"]
    left = sized(vectors).withColumns({"rb": block("id", "rbs"), "qb": every("qbs")})
    right = sized(queries).withColumns({"qb": block("query_id", "qbs"), "rb": every("rbs")})

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        block = query_block(asked, k, metric)
        batches = _arrow_batches(iter(rows.to_batches()), block)
        best = blocks.top_k(batches if len(asked) else iter(()), block)
        return pa.Table.from_batches([blocks.result_batch(best, block)])

    return (
        left.select("id", "embedding", *keys).groupBy(*keys)
        .cogroup(right.select("query_id", "q", *keys).groupBy(*keys))
        .applyInArrow(cell, blocks.RESULT_SCHEMA)
    )


def queries_within(queries: DataFrame, max_bytes: int) -> pa.Table | None:
    """All query rows if they take at most ``max_bytes``, else ``None``."""
    few = queries.limit(FEW_QUERIES).toArrow()
    elements = pc.sum(pc.list_value_length(few.column("q"))).as_py() or 0
    if len(few) < FEW_QUERIES:
        return few if 8 * elements <= max_bytes else None
    return sizing.collect_bounded(queries, max_bytes // max(8, 8 * elements // len(few)))


def _exact(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str, max_query_bytes: int
) -> tuple[DataFrame, int | None]:
    """Hits, and the most rows they can have where that is known.

    ``queries`` may carry their own numbers of hits in ``_k``; hits beyond a query's own are among
    those returned.
    """
    if metric not in blocks.METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(blocks.METRICS)}")
    own = F.col("_k") if "_k" in queries.columns else F.lit(k)
    queries = queries.filter(F.col("q").isNotNull()).select("query_id", "q", own.cast("int").alias("k"))
    vectors = vectors.filter(F.col("embedding").isNotNull())
    fan_in = many_tasks(vectors)
    spark = vectors.sparkSession
    path = query_blocks.work_folder(spark)
    rows = queries_within(queries, min(max_query_bytes, SENT_BYTES))
    many = rows is None or query_blocks.HIT_STATE * (pc.sum(rows.column("k")).as_py() or 0) > SENT_BYTES
    if many and query_blocks.readable(path):
        asked, most, largest = queries.agg(
            F.sum(F.size("q").cast("long") * 8), F.sum(F.col("k").cast("long")), F.max("k")
        ).first()
        searched = vectors.agg(F.sum(F.size("embedding").cast("long") * 8)).first()[0] or 0
        if searched <= ROWS_PER_QUERY * (asked + query_blocks.HIT_STATE * most):
            query_blocks.write_rows(vectors, path, metric, largest)
            return per_query_top(query_blocks.meet(queries, path, metric), "query_id", k), most
    if rows is None:
        rows = queries_within(queries, max_query_bytes)
    if rows is not None:
        held = query_blocks.of_table(rows, metric, max_query_bytes)
        most = sum(len(block.ids) * block.k for block in held)
        if query_blocks.HIT_STATE * most <= STATE_BYTES:
            found = query_blocks.scan_sent(vectors, held)
            return per_query_top(found, "query_id", k, fan_in), most
    if not query_blocks.readable(path):
        return per_query_top(by_grid(vectors, queries, k, metric, max_query_bytes), "query_id", k), None
    query_blocks.write(queries, path, metric, max_query_bytes)
    return per_query_top(query_blocks.scan(vectors, path, metric), "query_id", k, fan_in), None


def broadcast_within(df: DataFrame, rows: int | None, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast if its known row bound allows; Catalyst cannot know such a bound."""
    return F.broadcast(df) if rows is not None and rows * row_bytes <= sizing.BROADCAST_BYTES else df


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_TOP_K,
    metric: str = "l2",
    max_query_bytes: int = sizing.COLLECT_BYTES,
) -> DataFrame:
    """Exact k nearest of ``vectors(id, embedding)`` for ``queries(query_id, q)``.

    Result ``(query_id, id, score, rank)``. A few queries are sent to every task. Of more, the smaller side is
    stored as blocks: mostly ``vectors``, which every task leads past its own queries; next to very many rows the
    queries (sent within ``max_query_bytes``). ``vectors`` are not shuffled either way, and results are equal.
    """
    found, bound = _exact(vectors, queries, k, metric, max_query_bytes)
    return broadcast_within(found, bound, HIT_BYTES)


def shape_hits(
    found: DataFrame,
    chunks: DataFrame,
    sources: DataFrame,
    base_url: str = text.DEFAULT_BASE_URL,
    bound: int | None = None,
) -> DataFrame:
    """Hits with title, correspondent, snippet and link.

    With a known ``bound`` on the hit rows they are broadcast, and neither the chunk text nor
    the state table is shuffled.
    """
    content = chunks.select("id", "doc_id", F.col("content").alias("snippet"))
    described = sources.select("doc_id", "title", F.col("correspondent").alias("correspondent_name"))
    located = content.join(broadcast_within(found, bound, HIT_BYTES), "id")
    return (
        described.join(broadcast_within(located, bound, SNIPPET_BYTES), "doc_id")
        .select(
            "query_id", "rank", "id", "doc_id", "title", "correspondent_name", "snippet", "score",
            text.document_url("doc_id", base_url).alias("source_url"),
        )
    )


def search(
    chunks: DataFrame,
    sources: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_TOP_K,
    metric: str = "l2",
    base_url: str = text.DEFAULT_BASE_URL,
    max_query_bytes: int = sizing.COLLECT_BYTES,
) -> DataFrame:
    """Top-k chunks of ingested documents per query, shaped as results.

    ``queries`` may carry its own ``top_k`` column, of any size; null and values below 1 stand
    for ``k``. The queries are evaluated once, however they are made.
    """
    queries, most = held_queries(queries, k)
    found, bound = _exact(searchable(chunks, sources), queries, most, metric, max_query_bytes)
    return shape_hits(own_top(found, queries, bound), chunks, sources, base_url, bound)


def held_queries(queries: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The queries written once, with each one's own number of hits, and the largest of these."""
    own = F.col("top_k") if "top_k" in queries.columns else F.lit(None).cast("int")
    held = sizing.materialize(
        queries.select("query_id", "q", F.coalesce(F.when(own > 0, own), F.lit(k)).cast("int").alias("_k")), "queries"
    )
    return held, held.agg(F.max("_k")).first()[0] or k


def own_top(found: DataFrame, queries: DataFrame, bound: int | None) -> DataFrame:
    wanted = broadcast_within(queries.select("query_id", "_k"), bound, HIT_BYTES)
    return found.join(wanted, "query_id").filter(F.col("rank") <= F.col("_k")).drop("_k")


def search_store(
    store: ChunkStore,
    queries: DataFrame,
    k: int = DEFAULT_TOP_K,
    metric: str = "l2",
    base_url: str = text.DEFAULT_BASE_URL,
) -> DataFrame:
    """``search`` over a chunk store: its own state join already leaves searchable chunks only."""
    chunks = store.chunks(status="DONE")
    queries, most = held_queries(queries, k)
    found, bound = _exact(chunks.select("id", "embedding"), queries, most, metric, sizing.COLLECT_BYTES)
    return shape_hits(own_top(found, queries, bound), chunks, store.sources(), base_url, bound)


def example_queries(chunks: DataFrame, query_id: str = "id") -> DataFrame:
    """Stored chunks as queries."""
    return chunks.filter(F.col("embedding").isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col("embedding").alias("q")
    )


def packed_codes(vectors: DataFrame) -> DataFrame:
    """``(id, code)``: the sign bits of each embedding, packed; 1/32 of the bytes of the floats."""
    return vectors.filter(F.col("embedding").isNotNull()).select(
        "id", bits.pack(bits.binary_quantize("embedding"))["words"].alias("code")
    )


def write_codes(vectors: DataFrame, path: str) -> DataFrame:
    """Store the packed codes once, for many searches."""
    packed_codes(vectors).write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def quantised_search(
    vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_TOP_K, oversample: int = 4, codes: DataFrame | None = None
) -> DataFrame:
    """Shortlist of ``k * oversample`` by Hamming distance of sign bits, re-ranked by exact L2.

    The shortlist scans ``codes(id, code)`` only, as ``write_codes`` stores them (made for this
    search if not given); the float vectors are read for the shortlist alone.
    """
    from folioseek.functions.vectors import l2_distance

    codes = sizing.materialize(packed_codes(vectors), "codes") if codes is None else codes
    queries = sizing.materialize(queries.filter(F.col("q").isNotNull()).select("query_id", "q"), "queries")
    asked_codes = queries.select("query_id", bits.pack(bits.binary_quantize("q"))["words"].alias("q"))
    rows = codes.select("id", F.col("code").alias("embedding"))
    found, bound = _exact(rows, asked_codes, k * oversample, "bits", sizing.COLLECT_BYTES)
    short = found.select("query_id", "id", F.col("score").alias("hamming"))
    # the floats of the queries are 32 times their codes, so their own size decides
    scored = (
        vectors.select("id", "embedding")
        .join(broadcast_within(short, bound, HIT_BYTES), "id")
        .join(F.broadcast(queries) if sizing.fits_broadcast(queries, measure=True) else queries, "query_id")
        .select("query_id", "id", "hamming", l2_distance("embedding", "q").alias("score"))
    )
    return per_query_top(scored, "query_id", k)
