"""Sparse vectors as ``struct<dim:int, entries:map<int,double>>``: 1-based index to nonzero value.

``map_zip_with`` walks two maps over the union of their keys, so a distance is one native
expression per row; no exploding, no join on the index, and no hot index. Two vectors of
unequal dimensions are an error, and so is a null element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.functions.vectors import compare as dense_compare
from folioseek.functions.vectors import cosine_from, let


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def sparse(entries, dim) -> Column:
    """A sparse vector of given entries (a map without zeros or nulls) and dimension."""
    dim = dim if isinstance(dim, Column) else F.lit(dim)
    return F.struct(dim.cast("int").alias("dim"), _col(entries).cast("map<int,double>").alias("entries"))


def to_sparse(a) -> Column:
    """Dense vector to sparse, zeros dropped."""

    def made(v: Column) -> Column:
        entries = F.transform(
            v.cast("array<double>"), lambda x, i: F.struct((i + 1).cast("int").alias("key"), x.alias("value"))
        )
        wrong = F.raise_error(F.lit("null element in a vector")).cast("struct<dim:int,entries:map<int,double>>")
        kept = sparse(F.map_from_entries(F.filter(entries, lambda e: e["value"] != 0.0)), F.size(v))
        return F.when(F.exists(v, lambda x: x.isNull()), wrong).when(v.isNotNull(), kept)

    return let(_col(a), made)


def to_dense(m) -> Column:
    """``array<double>`` of all elements; an index beyond the dimension is an error.

    One merge of the map with an all-zero map, which ``map_zip_with`` keeps in order.
    """

    def made(v: Column) -> Column:
        dim, entries = v["dim"], v["entries"]
        outside = F.exists(F.map_keys(entries), lambda k: (k < 1) | (k > dim))
        slots = F.when(dim > 0, F.sequence(F.lit(1), dim)).otherwise(F.array().cast("array<int>"))
        zeros = F.map_from_arrays(slots, F.array_repeat(F.lit(0.0), dim))
        merged = F.map_zip_with(zeros, entries, lambda k, z, x: F.coalesce(x, z))
        wrong = F.raise_error(F.concat(F.lit("sparse index outside 1.."), dim.cast("string"))).cast("array<double>")
        return F.when(outside, wrong).otherwise(F.map_values(merged))

    return let(_col(m), made)


def to_long(df: DataFrame, key: str, sparse: str) -> DataFrame:
    """Long form: one ``(key, dim, value)`` row per nonzero element."""
    return df.select(key, F.explode(f"{sparse}.entries").alias("dim", "value"))


SUMS = ("inner", "l2_squared", "l1", "left", "right")


def sums(a, b) -> Column:
    """What all distances of a pair are made of, from one merge and one pass over it; null if either is null.

    A struct of the inner product, the squared L2 and the L1 distance, and the squared norms of both sides.
    """
    zero = F.lit(0.0)
    kind = f"struct<{','.join(f'{name}:double' for name in SUMS)}>"
    wrong = F.raise_error(F.lit("sparse vectors of different dimensions")).cast(kind)
    begin = F.struct(*[zero.alias(name) for name in SUMS])

    def added(total: Column, e: Column) -> Column:
        x, y = e["x"], e["y"]
        gap = x - y
        terms = (x * y, gap * gap, F.abs(gap), x * x, y * y)
        return F.struct(*[(total[name] + term).alias(name) for name, term in zip(SUMS, terms, strict=True)])

    def merged(v: Column) -> Column:
        a, b = v["a"], v["b"]
        both = F.map_zip_with(
            a["entries"], b["entries"], lambda k, x, y: F.struct(F.coalesce(x, zero).alias("x"), F.coalesce(y, zero).alias("y"))
        )
        total = F.aggregate(F.map_values(both), begin, added)
        return F.when(a.isNull() | b.isNull(), F.lit(None).cast(kind)).when(a["dim"] == b["dim"], total).otherwise(wrong)

    return let(F.struct(_col(a).alias("a"), _col(b).alias("b")), merged)


def distances(a, b) -> Column:
    """All distances of a pair as a struct: l2, l2_squared, l1, inner_product, negative_inner, cosine."""

    def named(t: Column) -> Column:
        whole = F.struct(
            F.sqrt(t["l2_squared"]).alias("l2"), t["l2_squared"].alias("l2_squared"), t["l1"].alias("l1"),
            t["inner"].alias("inner_product"), (F.lit(0.0) - t["inner"]).alias("negative_inner"),
            cosine_from(t["inner"], F.sqrt(t["left"]) * F.sqrt(t["right"])).alias("cosine"),
        )
        return F.when(t.isNotNull(), whole)

    return let(sums(a, b), named)


def inner_product(a, b) -> Column:
    return sums(a, b)["inner"]


def negative_inner_product(a, b) -> Column:
    return F.lit(0.0) - inner_product(a, b)


def l2_squared_distance(a, b) -> Column:
    return sums(a, b)["l2_squared"]


def l2_distance(a, b) -> Column:
    return F.sqrt(l2_squared_distance(a, b))


def l1_distance(a, b) -> Column:
    return sums(a, b)["l1"]


def norm(a) -> Column:
    squares = F.transform(F.map_values(_col(a)["entries"]), lambda v: v * v)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))


def cosine_distance(a, b) -> Column:
    """One minus the cosine; NaN where a norm is zero."""
    return distances(a, b)["cosine"]


def normalize(a) -> Column:
    """Unit length; the zero vector stays as it is."""

    def unit(m: Column) -> Column:
        return let(norm(m), lambda size: sparse(F.transform_values(m["entries"], lambda k, v: v / size), m["dim"]))

    return let(_col(a), unit)


def _ordered(a) -> Column:
    """Entries sorted by index."""
    return F.array_sort(F.map_entries(_col(a)["entries"]))


def equals(a, b) -> Column:
    """Whether dimensions and all elements are equal."""
    a, b = _col(a), _col(b)
    return (a["dim"] == b["dim"]) & (_ordered(a) == _ordered(b))


def compare(a, b) -> Column:
    """-1, 0 or 1 in the order of the dense forms."""
    both = F.struct(to_dense(a).alias("x"), to_dense(b).alias("y"))
    return let(both, lambda v: dense_compare(v["x"], v["y"]))
