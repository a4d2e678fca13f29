"""Query sets of any size, stored once as blocks that every scan task takes one after another.

The smaller side is stored. Where that is the queries, the vectors searched are neither moved nor repeated. Each task holds a bounded piece of its own rows and leads
all stored blocks past it, one at a time, so its memory is one piece of rows, one block of
queries and that block's hits. Queries that want like numbers of hits stand together in a block, and a block's
size counts its hits, so a few queries with many hits do not make room for as many in all others.

Blocks lie in the shared folder as Parquet, a row per block; with a folder per list they serve
clustered search, where a task opens the blocks of its rows' lists alone.

Where the queries are many, the rows are stored (``write_rows``) and every task leads them past its own queries
(``meet``): each query's hits are then found in one task, by the best of all rows before, and not merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioseek.operators import blocks
from folioseek.plans import sizing
from folioseek.plans.shipping import ship_package

#: Bytes of one query's hit in a task: two scores and an id.
HIT_STATE = 24
#: Bytes of a task's own rows that are held while the blocks go past.
HELD_ROWS = 64 * 1024 * 1024
#: Bytes of a task's own queries and their hits that are held while stored rows go past.
HELD_QUERIES = 64 * 1024 * 1024
#: Parts into which the queries are dealt per core, and queries of a part that are taken up at once.
TASKS_PER_CORE, SLICE = 2, 1000

LAYOUT = "k int, width int, ids binary, q binary"


def split(ids: np.ndarray, vectors: np.ndarray, k: np.ndarray, metric: str, max_bytes: int) -> Iterator[blocks.QueryBlock]:
    """Blocks of queries whose numbers of hits lie within a factor of two, in ascending number."""
    order = np.lexsort((ids, k))
    ids, vectors, k = ids[order], vectors[order], k[order]
    levels = np.frexp(np.maximum(k, 1) - 0.5)[1]  # 1, 2, 3-4, 5-8, ...
    low = 0
    while low < len(ids):
        most = int(k[np.searchsorted(levels, levels[low], "right") - 1])
        rows = max(1, max_bytes // (8 * max(1, vectors.shape[1]) + HIT_STATE * most))
        high = min(low + rows, int(np.searchsorted(levels, levels[low], "right")))
        yield blocks.QueryBlock(ids[low:high], vectors[low:high], int(k[high - 1]), metric)
        low = high


def of_table(rows: pa.Table, metric: str, max_bytes: int) -> list[blocks.QueryBlock]:
    """Collected queries (query_id, q, k) as blocks."""
    ids, k = (rows.column(c).to_numpy().astype("int64") for c in ("query_id", "k"))
    return list(split(ids, blocks.rows_of(rows.column("q"), metric), k, metric, max_bytes))


def write(queries: DataFrame, path: str, metric: str, max_bytes: int, by: str | None = None) -> None:
    """Store queries (query_id, q, k) as blocks; ``by`` is a column whose values get a folder each."""
    ship_package(queries.sparkSession)
    marks = [by] if by else []

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marked = table.column(by).to_numpy() if by else np.zeros(len(table), int)
            for mark in np.unique(marked).tolist():
                own = table.filter(pa.array(marked == mark))
                for block in of_table(own, metric, max_bytes):
                    kind = "<u8" if metric == "bits" else "<f8"
                    columns = {
                        "k": [block.k], "width": [block.vectors.shape[1]], "ids": [block.ids.astype("<i8").tobytes()],
                        "q": [np.ascontiguousarray(block.vectors.astype(kind)).tobytes()],
                    }
                    schema = pa.schema([("k", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("q", pa.binary())])
                    made = pa.RecordBatch.from_pydict(columns, schema)
                    yield pa.RecordBatch.from_arrays([*made.columns, *([pa.array([mark], pa.int32())] if by else [])], [*schema.names, *marks])

    rows = queries.select("query_id", "q", F.col("k").cast("int").alias("k"), *[F.col(c).cast("int").alias(c) for c in marks])
    if by:
        rows = rows.hint("rebalance", by).sortWithinPartitions(by, "k")
    made = rows.mapInArrow(packed, LAYOUT + "".join(f", {c} int" for c in marks))
    with sizing.shuffle_files_removed(queries.sparkSession):
        (made.write.partitionBy(by) if by else made.write).parquet(path)


def write_rows(vectors: DataFrame, path: str, metric: str, most: int, held: int = HELD_ROWS) -> None:
    """Store vectors (id, embedding) as blocks in which near rows stand together.

    Of equal rows in a piece only the ``most`` lowest ids are stored, as no other can be among that many hits.
    """
    ship_package(vectors.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, rows in _pieces(batches, metric, None, held):
            kept = blocks.lowest_copies(rows, ids, most)
            ids, rows = ids[kept], rows[kept]
            if metric in ("l2", "l1"):
                order = blocks.near_order(rows, blocks.TILE_ROWS)
                ids, rows = ids[order], rows[order]
            step = max(1, held // 8 // max(1, 8 * rows.shape[1]) // blocks.TILE_ROWS) * blocks.TILE_ROWS
            for low in range(0, len(ids), step):
                part = slice(low, low + step)
                kind = "<u8" if metric == "bits" else "<f8"
                yield pa.RecordBatch.from_pydict(
                    {
                        "k": [1], "width": [rows.shape[1]], "ids": [ids[part].astype("<i8").tobytes()],
                        "q": [np.ascontiguousarray(rows[part].astype(kind)).tobytes()],
                    },
                    pa.schema([("k", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("q", pa.binary())]),
                )

    with sizing.shuffle_files_removed(vectors.sparkSession):
        vectors.select("id", "embedding").mapInArrow(packed, LAYOUT).write.parquet(path)


def meet(queries: DataFrame, path: str, metric: str, held: int = HELD_QUERIES) -> DataFrame:
    """Hits of queries (query_id, q, k) among the rows stored by ``write_rows``: ``query_id, id, score``.

    Queries are stored once, dealt over all cores; a task leads the stored rows past bounded pieces of its own.
    """
    ship_package(queries.sparkSession)
    dealt = queries.select("query_id", "q", F.col("k").cast("int").alias("k"))
    dealt = dealt.repartition(TASKS_PER_CORE * queries.sparkSession.sparkContext.defaultParallelism)
    dealt = sizing.materialize(dealt, "asked")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        taken, size = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                own = part.nbytes * 2 + 3 * HIT_STATE * int(part.column("k").to_numpy().astype("int64").sum())
                if taken and size + own > held:
                    yield pa.Table.from_batches(taken)
                    taken, size = [], 0
                taken.append(part)
                size += own
        if taken:
            yield pa.Table.from_batches(taken)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            asked = []
            for block in of_table(piece, metric, held):
                if metric in ("l2", "l1"):
                    order = blocks.near_order(block.vectors, blocks.TILE_QUERIES)
                    block = blocks.QueryBlock(block.ids[order], block.vectors[order], block.k, metric)
                asked.append((block, blocks.Best(len(block.ids), block.k), blocks.prepared(block.vectors, metric)))
            for rows in stored(path, metric):
                ready = blocks.prepared(rows.vectors, metric)
                for block, best, prepared in asked:
                    if rows.vectors.shape[1] != block.vectors.shape[1]:
                        raise ValueError(f"different vector dimensions {block.vectors.shape[1]} and {rows.vectors.shape[1]}")
                    blocks.offer(best, ready, rows.ids, prepared, metric)
            for block, best, _ in asked:
                yield blocks.result_batch(best, block)

    return dealt.mapInArrow(found, blocks.RESULT_SCHEMA)


def readable(path: str) -> bool:
    """Whether tasks can open the shared folder themselves: local and network folders, HDFS and object stores can be."""
    try:
        fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    except (pa.ArrowException, ValueError, OSError):
        return False
    return True


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def stored(path: str, metric: str) -> Iterator[blocks.QueryBlock]:
    """The blocks below a folder, one in memory at a time; none if there is no such folder."""
    system, folder = _opened(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    for file in sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet")):
        with system.open_input_file(file) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1, columns=["k", "width", "ids", "q"]):
                for row in batch.to_pylist():
                    vectors = np.frombuffer(row["q"], "<u8" if metric == "bits" else "<f8").reshape(-1, row["width"])
                    yield blocks.QueryBlock(np.frombuffer(row["ids"], "<i8"), vectors, row["k"], metric)


def _pieces(batches: Iterator[pa.RecordBatch], metric: str, by: str | None, held: int):
    """Rows of a task in pieces of bounded size, all of one value of ``by``: value, ids, vectors."""
    ids, rows, size, mark = [], [], 0, None

    for batch in batches:
        if not batch.num_rows:
            continue
        marked = batch.column(by).to_numpy() if by else np.zeros(batch.num_rows, int)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(marked)) + 1, [len(marked)]])
        vectors, own = blocks.rows_of(batch.column("embedding"), metric), batch.column("id").to_numpy()
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if rows and (marked[low] != mark or size > held):
                yield mark, np.concatenate(ids), np.concatenate(rows)
                ids, rows, size = [], [], 0
            mark = marked[low]
            if rows and rows[0].shape[1] != vectors.shape[1]:
                raise ValueError(f"different vector dimensions {rows[0].shape[1]} and {vectors.shape[1]}")
            ids.append(own[low:high])
            rows.append(vectors[low:high])
            size += rows[-1].nbytes
    if rows:
        yield mark, np.concatenate(ids), np.concatenate(rows)


def scan(vectors: DataFrame, path: str, metric: str, by: str | None = None, held: int = HELD_ROWS) -> DataFrame:
    """Hits of each piece of rows for each block: ``query_id, id, score``; ``vectors`` is not shuffled.

    With ``by`` rows meet the blocks of their own value's folder only.
    """
    ship_package(vectors.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mark, ids, rows in _pieces(batches, metric, by, held):
            for block in stored(f"{path}/{by}={mark}" if by else path, metric):
                if rows.shape[1] != block.vectors.shape[1]:
                    raise ValueError(f"different vector dimensions {block.vectors.shape[1]} and {rows.shape[1]}")
                yield blocks.result_batch(blocks.top_k(iter([(ids, rows)]), block), block)

    return vectors.select("id", "embedding", *([by] if by else [])).mapInArrow(found, blocks.RESULT_SCHEMA)


def scan_sent(vectors: DataFrame, sent: list[blocks.QueryBlock]) -> DataFrame:
    """One pass over ``vectors`` past a few blocks that travel as a broadcast variable."""
    ship_package(vectors.sparkSession)
    held = vectors.sparkSession.sparkContext.broadcast(sent)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [blocks.Best(len(block.ids), block.k) for block in held.value]
        prepared = [blocks.prepared(block.vectors, block.metric) for block in held.value]
        for batch in batches:
            if not batch.num_rows or not best:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for block, own, queries in zip(held.value, best, prepared, strict=True):
                rows = blocks.prepared(blocks.rows_of(batch.column("embedding"), block.metric, block.vectors.shape[1]), block.metric)
                blocks.offer(own, rows, ids, queries, block.metric)
        for own, block in zip(best, held.value, strict=True):
            yield blocks.result_batch(own, block)

    return vectors.select("id", "embedding").mapInArrow(found, blocks.RESULT_SCHEMA)


def work_folder(spark: SparkSession) -> str:
    return sizing.work_path(spark, "query_blocks")
