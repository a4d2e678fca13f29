"""Element-wise aggregates of vector columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.plans import sizing


def _summary(df: DataFrame, group: str, vector: str, metric: str, into: str) -> DataFrame:
    """Aggregate whole vectors of each group in the JVM, with map-side partials of one vector per group and task.

    Null vectors are left out. Vectors of unequal width in a group, and null elements, are an error.
    """
    total = Summarizer.metrics(metric).summary(array_to_vector(vector)).alias("_s")
    kept = df.filter(F.col(vector).isNotNull()).groupBy(group).agg(total)
    return kept.select(group, vector_to_array(f"_s.{metric}").alias(into))


def vector_avg(df: DataFrame, group: str, vector: str = "embedding", into: str = "centroid") -> DataFrame:
    return _summary(df, group, vector, "mean", into)


def vector_sum(df: DataFrame, group: str, vector: str = "embedding", into: str = "total") -> DataFrame:
    return _summary(df, group, vector, "sum", into)


def chunk_counts(chunks: DataFrame, condition: Column | None = None) -> DataFrame:
    """Number of chunks per document, optionally of those that satisfy a condition."""
    kept = chunks if condition is None else chunks.filter(condition)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


def first_chunks(chunks: DataFrame) -> DataFrame:
    """Text of the lowest-numbered chunk of each document."""
    return chunks.groupBy("doc_id").agg(F.min_by("content", "chunk_index").alias("content"))


def duplicate_vectors(df: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Groups of equal vectors: smallest key and number of copies.

    Hashes are counted first, eight bytes a row; only rows whose hash repeats are grouped by
    the vector itself, and copies fold on the map side. With too many repeated hashes to
    broadcast, all rows are grouped directly.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(key, vector, F.xxhash64(vector).alias("_hash"))
    repeated = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_hash")
    if sizing.fits_broadcast(repeated, measure=True):
        rows = rows.join(F.broadcast(repeated), "_hash", "left_semi")
    return (
        rows.groupBy(vector)
        .agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .select("first_id", "copies")
    )
