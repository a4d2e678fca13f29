"""Size checks and skew-safe joins.

A side is broadcast only after its estimated size has been looked at; past the bound the
same join is a shuffle whose hot keys, counted first, and null keys are cut into parts, so none
lands in one task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
COLLECT_BYTES = 64 * 1024 * 1024
#: Hot keys that a join looks for at most; beyond so many, each holds less than a thousandth of the rows.
MOST_HOT = 1000


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (huge where nothing is known)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows, by one distributed aggregate; nested values count as their JSON text."""
    total = F.lit(16 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            total = total + F.octet_length(F.to_json(F.struct(field.name)))
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES, measure: bool = False) -> bool:
    """Whether ``df`` may be broadcast.

    The estimate multiplies through joins and then says too much; with ``measure`` a negative
    answer is checked by counting, which pays where the other choice shuffles wide rows.
    """
    return estimated_bytes(df) <= limit or (measure and measured_bytes(df) <= limit)


def lookup_join(
    big: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "left",
    limit: int = BROADCAST_BYTES,
    salts: int | None = None,
    spread: str | None = None,
    measure: bool = False,
) -> DataFrame:
    """Join ``big`` to a lookup table on the shared column ``key``.

    ``dim`` must hold each key once for a join that keeps the number of rows. Within ``limit`` it is broadcast
    and ``big`` is not shuffled. Past it ``skew_join`` spreads hot and null keys.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join does not support {how!r}")
    added = [] if how in ("left_semi", "left_anti") else [c for c in dim.columns if c != key]
    if fits_broadcast(dim, limit, measure):
        return big.join(F.broadcast(dim), key, how).select(*big.columns, *added)
    return skew_join(big, dim, key, how, spread, salts).select(*big.columns, *added)


def hot_keys(df: DataFrame, key: str, tasks: int) -> dict[int, int]:
    """Hashes of the keys that hold more than twice an even task's rows, and the parts to cut them into.

    One pass over the key column with a sketch of the most frequent keys; counts are upper bounds, which only
    moves rows between tasks. A part is about a quarter of an even task's rows.
    """
    most = min(MOST_HOT, tasks)  # no more keys can hold that much
    hashed = df.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    rows, top = hashed.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(h, {most}, {8 * most})")).first()
    even = rows / tasks
    return {item["item"]: min(4 * tasks, -(-4 * item["count"] // max(1, int(even)))) for item in top or [] if item["count"] > 2 * even}


def skew_join(big: DataFrame, dim: DataFrame, key: str, how: str, spread: str | None = None, salts: int | None = None) -> DataFrame:
    """Shuffle join in which no key's rows of ``big`` stay together if they are too many for a task.

    Hot keys are counted first and cut by a hash of ``spread`` (or of every column but the key) into as
    many parts as they need, ``salts`` at most; only their rows of ``dim`` are repeated, once per part. Rows
    with a null key match nothing and are dealt out evenly.
    """
    spark = big.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = [(h, n if salts is None else min(n, salts)) for h, n in hot_keys(big, key, tasks).items()]
    parts = F.broadcast(spark.createDataFrame(hot, "_hash long, _parts int"))  # MOST_HOT rows at most
    hashed = [spread] if spread else [c for c in big.columns if c != key]
    part = F.xxhash64(*hashed)

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_hash", F.xxhash64(key)).join(parts, "_hash", "left").drop("_hash") if hot else df.withColumn("_parts", F.lit(1))

    cut = F.when(F.col(key).isNull(), F.pmod(part, F.lit(4 * tasks))).otherwise(F.pmod(part, F.coalesce("_parts", F.lit(1))))
    left = marked(big).withColumn("_salt", cut.cast("int")).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    right = marked(dim.filter(F.col(key).isNotNull())).withColumn("_salt", copies).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def fill_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input that is too small to give every core a full split, before costly work.

    Files with few row groups read as few tasks. Large inputs are left alone: they have
    splits enough and a shuffle of them would cost more than it gains. Without ``keys`` rows
    are dealt out in turn; keys should be unique, or equal ones meet in one task.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores, *keys) if estimated_bytes(df) < cores * split else df


def collect_bounded(df: DataFrame, max_rows: int) -> pa.Table | None:
    """Rows of ``df`` when there are at most ``max_rows`` of them, else ``None``."""
    rows = df.limit(max_rows + 1).toArrow()
    return rows if len(rows) <= max_rows else None


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``, or one set here if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioseek-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting to remove a query's shuffle files as soon as the query has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind; the session's own setting comes back afterwards."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    The shuffle files of the write are removed at its end, as nothing reads them again. ``release``
    removes the table.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    with shuffle_files_removed(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._work_path = path
    return stored


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder and all below it, wherever Spark's paths lead."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def release(*stored: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote; nothing may read them, or what was derived from them, again."""
    for df in stored:
        remove_path(df.sparkSession, df._work_path)


def dense_ids(
    df: DataFrame, key: str, start: Column | int = 0, partitions: int | None = None, name: str = "id"
) -> DataFrame:
    """Number rows ``start + 1, start + 2, ...`` in the order of a unique integer key.

    A global ``row_number`` would sort everything in one task. Here rows are range-partitioned
    by key and stored, each row with its range; rows are ranked inside their range, and the
    number of rows in the ranges before it, at most one per partition, is added.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, key).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = dict(ranged.groupBy("_range").count().collect())  # one row per partition
    offsets, total = {}, 0
    for part in sorted(sizes):
        offsets[part], total = total, total + sizes[part]
    before = F.lit(0).cast("long")
    if offsets:
        before = F.element_at(F.array(*[F.lit(offsets.get(p, 0)).cast("long") for p in range(n)]), F.col("_range") + 1)
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    base = start if isinstance(start, Column) else F.lit(start)
    return ranged.withColumn(name, base.cast("long") + before + rank).drop("_range")
