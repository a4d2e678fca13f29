"""Operators on dense vector columns (``array<float>`` or ``array<double>``).

Arithmetic is done in double. Two vectors of unequal length are an error, as in the vector
type of the source system; ``zip_with`` alone would pad with null and hide it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda computes the outer expressions it mentions anew for every element; a lambda's own
    variable is just read.
    """
    return F.transform(F.array(value), body)[0]


def _doubles(a: Column) -> Column:
    """The whole array cast at once, which is cheaper than a cast inside each lambda."""
    return a.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)


def _checked(a: Column, b: Column, result: Column, kind: str) -> Column:
    """``result``, or an error where the two lengths differ (null where either is null)."""
    wrong = F.raise_error(
        F.concat(
            F.lit("different vector dimensions "),
            F.size(a).cast("string"),
            F.lit(" and "),
            F.size(b).cast("string"),
        )
    )
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast(kind))
        .when(F.size(a) == F.size(b), result)
        .otherwise(wrong.cast(kind))
    )


def _pairwise(a, b, f, fold=_total) -> Column:
    a, b = _col(a), _col(b)
    return _checked(a, b, fold(F.zip_with(_doubles(a), _doubles(b), f)), "double")


def _elementwise(a, b, f) -> Column:
    a, b = _col(a), _col(b)
    return _checked(a, b, F.zip_with(_doubles(a), _doubles(b), f), "array<double>")


def l2_squared_distance(a, b) -> Column:
    return _pairwise(a, b, lambda x, y: x - y, _squares)


def l2_distance(a, b) -> Column:
    return F.sqrt(l2_squared_distance(a, b))


def l1_distance(a, b) -> Column:
    return _pairwise(a, b, lambda x, y: F.abs(x - y))


def inner_product(a, b) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def negative_inner_product(a, b) -> Column:
    return F.lit(0.0) - inner_product(a, b)


def norm(a) -> Column:
    return F.sqrt(_squares(_doubles(_col(a))))


def clamp(x: Column) -> Column:
    """Within -1 and 1; null stays null (``greatest`` and ``least`` would skip it)."""
    return F.when(x > 1.0, F.lit(1.0)).when(x < -1.0, F.lit(-1.0)).otherwise(x)


def cosine_distance(a, b) -> Column:
    """One minus the cosine; NaN where a norm is zero."""
    return cosine_from(inner_product(a, b), norm(a) * norm(b))


def cosine_from(product: Column, size: Column) -> Column:
    """Cosine distance from an inner product and the product of the norms; null from null."""
    return let(
        F.struct(product.alias("p"), size.alias("s")),
        lambda v: F.when(v["s"] == 0.0, F.lit(NAN)).otherwise(
            F.lit(1.0) - clamp(v["p"] / F.when(v["s"] != 0.0, v["s"]))
        ),
    )


def spherical_distance(a, b) -> Column:
    """Angle over pi; both inputs are expected to have unit length."""
    return F.acos(clamp(inner_product(a, b))) / F.lit(math.pi)


def normalize(a) -> Column:
    """Unit length; the zero vector stays zero."""
    def scaled(v: Column, size: Column) -> Column:
        return F.when(size == 0.0, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x / size))

    return let(_doubles(_col(a)), lambda v: let(F.sqrt(_squares(v)), lambda size: scaled(v, size)))


def add(a, b) -> Column:
    return _elementwise(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return _elementwise(a, b, lambda x, y: x - y)


def multiply(a, b) -> Column:
    return _elementwise(a, b, lambda x, y: x * y)


def concat(a, b) -> Column:
    return F.concat(_col(a), _col(b))


def subvector(a, start: int, count: int) -> Column:
    """``count`` elements from 1-based ``start``; a start below 1 eats into the count."""
    if count < 1:
        raise ValueError("a vector has at least one dimension")
    first = max(start, 1)
    length = start + count - first
    if length < 1:
        raise ValueError("a vector has at least one dimension")
    return F.slice(_col(a), first, length)


def dims(a) -> Column:
    a = _col(a)
    return F.when(a.isNotNull(), F.size(a))


def compare(a, b) -> Column:
    """-1, 0 or 1: by the first differing element, then the shorter one first."""
    a, b = _col(a), _col(b)
    return F.when(a < b, F.lit(-1)).when(a == b, F.lit(0)).when(a > b, F.lit(1))


def to_vector(a, dim: int | None = None) -> Column:
    """Numeric array to ``array<float>``, checking the width when one is given.

    Also the cast between vector types. Null elements are an error.
    """
    a = _col(a)
    cast = F.transform(a, lambda x: x.cast("float"))
    holes = F.exists(a, lambda x: x.isNull())
    checked = F.when(holes, F.raise_error(F.lit("vector holds a null element")).cast("array<float>"))
    if dim is not None:
        message = F.concat(
            F.lit(f"expected {dim} dimensions, not "), F.size(a).cast("string")
        )
        checked = checked.when(F.size(a) != dim, F.raise_error(message).cast("array<float>"))
    return F.when(a.isNull(), F.lit(None).cast("array<float>")).otherwise(checked.otherwise(cast))


def to_array(a) -> Column:
    return F.transform(_col(a), lambda x: x.cast("float"))


DISTANCES = {
    "l2": l2_distance,
    "l1": l1_distance,
    "cosine": cosine_distance,
    "inner": negative_inner_product,
    "spherical": spherical_distance,
}
