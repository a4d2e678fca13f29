"""Bounded samples for training on the driver: one row per id, and a bound of what they hold together."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioseek.plans.sizing import materialize, release


def one_text_each(docs: DataFrame, chosen: DataFrame, *keys: str) -> DataFrame:
    """The chosen rows with the least text of their key; however often an id is repeated, one row comes out.

    ``chosen`` has each key once and a stated bound of rows, so it is broadcast; tasks keep the least text
    they see of a key. Rows whose texts are all null are left out.
    """
    found = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), list(keys))
    return found.groupBy(*chosen.columns).agg(F.min("text").alias("text"))


def collected(sample: DataFrame, size: str, bound: int, *order: Column | str) -> pa.Table:
    """Rows of a bounded sample in order, as far as their sizes together stay within ``bound``.

    A row larger than ``bound`` by itself is passed over. Only numbers meet in one task to be added up; the
    rows that count come to the driver, the others do not.
    """
    rows = materialize(sample.withColumn("_order", F.struct(*order)).withColumn("_row", F.monotonically_increasing_id()), "sample")
    upto = F.sum(size).over(Window.orderBy("_order", "_row").rowsBetween(Window.unboundedPreceding, 0))
    fitting = rows.where(F.col(size) <= bound).select("_row", "_order", size).withColumn("_upto", upto).where(F.col("_upto") <= bound)
    found = rows.join(F.broadcast(fitting.select("_row")), "_row").orderBy("_order", "_row").drop("_row", "_order").toArrow()
    release(rows)
    return found
