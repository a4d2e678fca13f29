"""Clustered (IVF) search: rows are stored by nearest centroid and only some lists are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioseek.operators import blocks, query_blocks
from folioseek.operators.search import by_grid, exact_top_k, many_tasks, per_query_top, queries_within, query_block
from folioseek.plans import sizing
from folioseek.plans.shipping import ship_package

LISTS = 100
MAX_CENTROID_BYTES = sizing.COLLECT_BYTES


def train_centroids(
    vectors: DataFrame, lists: int = LISTS, seed: int = 42, iterations: int = 20, fraction: float = 1.0
) -> DataFrame:
    """``(list_id, centroid)`` by k-means.

    Centroids decide where rows are stored, not what a full search finds, so a ``fraction``
    below 1 may train on a sample of a very large table.
    """
    train = vectors.filter(F.col("embedding").isNotNull())
    if fraction < 1.0:
        train = train.sample(fraction, seed)
    points = train.select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=iterations).fit(points)
    centers = [[float(x) for x in c] for c in model.clusterCenters()]
    table = pa.table({
        "list_id": pa.array(range(len(centers)), pa.int32()),
        "centroid": pa.array(centers, pa.list_(pa.float64())),
    })
    return vectors.sparkSession.createDataFrame(table)


def _centroid_block(centroids: DataFrame, metric: str, k: int = 1) -> blocks.QueryBlock:
    columns = centroids.select(F.col("list_id").alias("query_id"), F.col("centroid").alias("q"))
    rows = queries_within(columns, MAX_CENTROID_BYTES)
    if rows is None or len(rows) == 0:
        raise ValueError("no centroids, or more than the broadcast bound; change the number of lists")
    return query_block(rows.sort_by("query_id"), k, metric)


def assign_lists(vectors: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """``vectors`` with ``list_id`` and ``list_distance`` of the nearest centroid, no shuffle."""
    ship_package(vectors.sparkSession)
    held = vectors.sparkSession.sparkContext.broadcast(_centroid_block(centroids, metric))
    schema = T.StructType([
        *vectors.schema.fields,
        T.StructField("list_id", T.IntegerType()),
        T.StructField("list_distance", T.DoubleType()),
    ])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in batches:
            rows = blocks.matrix(batch.column("embedding"), block.vectors.shape[1])
            list_ids = np.empty(len(rows), dtype="int32")
            distances = np.empty(len(rows))
            step = max(1, blocks.CELLS // len(block.ids))
            for i in range(0, len(rows), step):
                part = slice(i, i + step)
                # Roles swapped: each row is a query for its one nearest centroid.
                asking = blocks.QueryBlock(np.arange(len(rows[part])), rows[part], 1, block.metric)
                _, list_ids[part], distances[part] = blocks.top_k(iter([(block.ids, block.vectors)]), asking).rows()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list_ids), pa.array(distances)],
                names=[*batch.schema.names, "list_id", "list_distance"],
            )

    return vectors.filter(F.col("embedding").isNotNull()).mapInArrow(scan, schema)


def write_lists(assigned: DataFrame, path: str) -> None:
    """Store rows partitioned by list; a rebalance splits hot lists and packs small ones."""
    assigned.drop("list_distance").hint("rebalance", "list_id").write.partitionBy("list_id").parquet(path)


def build_index(
    vectors: DataFrame, path: str, lists: int = LISTS, seed: int = 42, fraction: float = 1.0, metric: str = "l2"
) -> None:
    """Cluster ``vectors(id, embedding)`` once and store rows and centroids below ``path``."""
    spark = vectors.sparkSession
    train_centroids(vectors, lists, seed, fraction=fraction).write.parquet(f"{path}/centroids")
    centroids = spark.read.parquet(f"{path}/centroids")
    write_lists(assign_lists(vectors.select("id", "embedding"), centroids, metric), f"{path}/rows")


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int = 10, metric: str = "l2"
) -> DataFrame:
    """``ivf_search`` over what ``build_index`` stored."""
    centroids = spark.read.parquet(f"{path}/centroids")
    return ivf_search(spark, f"{path}/rows", centroids, queries, k, probes, metric)


def nearest_lists(queries: DataFrame, centroids: DataFrame, probes: int, metric: str = "l2") -> DataFrame:
    """``(query_id, list_id, place)`` of the ``probes`` nearest centroids of each query."""
    lists = centroids.select(F.col("list_id").cast("long").alias("id"), F.col("centroid").alias("embedding"))
    found = exact_top_k(lists, queries, probes, metric)
    return found.select("query_id", F.col("id").cast("int").alias("list_id"), F.col("rank").alias("place"))


def ivf_search(
    spark: SparkSession,
    path: str,
    centroids: DataFrame,
    queries: DataFrame,
    k: int = 5,
    probes: int = 10,
    metric: str = "l2",
    max_query_bytes: int = sizing.COLLECT_BYTES,
) -> DataFrame:
    """k nearest among the rows of the ``probes`` nearest lists of each query.

    The probed lists of all queries are a table; its lists prune the folders that are scanned, while
    the job runs. The queries of each list are stored as blocks of ``max_query_bytes`` in a folder
    of their own, which the tasks that hold rows of that list lead past them, so neither rows nor
    probes pass through the driver or a shuffle by list. With every list probed the result equals the
    exact search. ``metric`` is the one the lists were assigned by.
    """
    queries = queries.select("query_id", "q").filter(F.col("q").isNotNull())
    stored = spark.read.parquet(path).select("id", "embedding", "list_id")
    probed = sizing.materialize(nearest_lists(queries, centroids, probes, metric), "probed")
    asked = queries.join(probed, "query_id").withColumn("k", F.lit(k))
    folder = query_blocks.work_folder(spark)
    if not query_blocks.readable(folder):
        return per_query_top(by_grid(stored, asked, k, metric, max_query_bytes, on="list_id"), "query_id", k)
    query_blocks.write(asked, folder, metric, max_query_bytes, by="list_id")
    # one row per list, of which there are as many as centroids within their own bound
    lists = probed.filter(F.col("place") <= probes).select("list_id").distinct()
    pruned = stored.join(F.broadcast(lists), "list_id", "left_semi")
    return per_query_top(query_blocks.scan(pruned, folder, metric, by="list_id"), "query_id", k, many_tasks(stored))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found, over all queries."""
    hits = exact.select("query_id", "id").join(
        found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left"
    )
    return hits.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))
