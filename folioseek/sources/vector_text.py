"""Vectors stored as text, ``[1,2,3]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.plans import sizing


def _numbers(value: Column) -> Column:
    body = F.regexp_replace(value, r"\A\[|\]\z", "")
    return F.transform(F.split(body, ",", -1), lambda x: F.trim(x).try_cast("float"))


def decode(df: DataFrame, column: str, into: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Decoded rows (null text gives an empty vector) and the rows that do not parse.

    The generator keeps the optimizer from copying the parse into every later use of it.
    """
    empty = F.array().cast("array<float>")
    numbers = F.when(F.col(column).isNull(), empty).otherwise(_numbers(F.col(column)))
    checked = F.transform(
        F.array(numbers), lambda v: F.struct(v.alias(into), F.exists(v, lambda x: x.isNull()).alias("_bad"))
    )
    parsed = sizing.fill_cores(df).select("*", F.inline_outer(checked))
    return parsed.filter(~F.col("_bad")).drop("_bad"), parsed.filter("_bad").drop(into, "_bad")


def parsed(column: str) -> Column:
    """A text vector as floats; null stays null, a text that does not parse is an error."""
    def checked(v: Column) -> Column:
        wrong = F.raise_error(F.concat(F.lit("not a vector: "), F.substring(column, 1, 40))).cast("array<float>")
        return F.when(F.exists(v, lambda x: x.isNull()), wrong).otherwise(v)

    return F.when(F.col(column).isNotNull(), F.transform(F.array(_numbers(F.col(column))), checked)[0])


def encode(vector) -> Column:
    """``[a, b]`` text of a vector."""
    vector = vector if isinstance(vector, Column) else F.col(vector)
    parts = F.transform(vector, lambda x: x.cast("float").cast("string"))
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
