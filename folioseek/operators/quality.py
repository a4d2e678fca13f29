"""Constraint checks: Spark does not enforce keys, so violations are queried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.functions import text


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def missing_parents(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child key values without a parent row, with their row counts (null keys are allowed).

    Children are counted per key first: a hot key is one row in the join.
    """
    counted = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return counted.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, violations)`` in one pass; a rule is violated where it is false or null."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    stacked = F.explode(
        F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])
    )
    return counts.select(stacked.alias("r")).select("r.rule", "r.violations")


def not_null(*columns: str) -> dict[str, Column]:
    return {f"{c} not null": F.col(c).isNotNull() for c in columns}


def allowed(column: str, values: tuple[str, ...]) -> dict[str, Column]:
    return {f"{column} allowed": F.col(column).isin(*values)}


def wrong_dimensions(df: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows whose vector is not ``dim`` wide (null vectors are allowed)."""
    return df.filter(F.size(column) != dim).filter(F.col(column).isNotNull())


def dimension_summary(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.when(F.col(column).isNotNull(), F.size(column)).alias("dims")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def embedding_counts(chunks: DataFrame) -> DataFrame:
    """Segments and embeddings per document, and the message where they differ."""
    counts = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("segments"), F.count("embedding").alias("embeddings")
    )
    message = text.count_mismatch("embeddings", "segments")
    return counts.withColumn("error", F.when(F.col("embeddings") != F.col("segments"), message))
