"""Sort keys with SQL-standard null placement and a unique last column.

The source system puts nulls last ascending and first descending; Spark does the opposite
by default, so every sort states it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def oldest_first(column: str, *tie: str) -> list[Column]:
    return [F.col(column).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]]


def newest_first(column: str, *tie: str) -> list[Column]:
    return [F.col(column).desc_nulls_first(), *[F.col(t).asc_nulls_last() for t in tie]]


def top(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows of a sort (per-task heaps, no full sort); all rows if ``None``."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)
