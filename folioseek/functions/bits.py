"""Bit vectors: quantised embeddings, packed to 64-bit words beside their number of bits.

Two vectors of unequal numbers of bits are an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioseek.functions.vectors import let

WORD = 64


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def binary_quantize(a) -> Column:
    """One bit per element, set where the element is positive."""
    return F.transform(_col(a), lambda x: x > 0)


def pack(bits) -> Column:
    """``array<boolean>`` to ``struct<n, words>``, bit ``i`` of a word for element ``i``."""
    return let(_col(bits), lambda b: F.when(b.isNotNull(), F.struct(F.size(b).alias("n"), _packed(b).alias("words"))))


def _packed(bits: Column) -> Column:
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def word(w: Column) -> Column:
        part = F.slice(bits, w * WORD + 1, F.lit(WORD))
        shifted = F.transform(
            part, lambda b, i: F.when(b, F.call_function("shiftleft", one, i)).otherwise(zero)
        )
        return F.aggregate(shifted, zero, lambda acc, v: acc.bitwiseOR(v))

    words = F.floor((F.size(bits) - 1) / WORD).cast("int")
    packed = F.transform(F.sequence(F.lit(0), words), word)
    return F.when(F.size(bits) > 0, packed).when(F.size(bits) == 0, F.array().cast("array<bigint>"))


def _bits(a: Column, b: Column, f) -> Column:
    counted = F.zip_with(a, b, lambda x, y: F.bit_count(f(x, y)))
    return F.aggregate(counted, F.lit(0), lambda acc, v: acc + v)


def _distance(a, b, of) -> Column:
    """``of`` the words of both, once their numbers of bits are known to be equal."""
    wrong = F.raise_error(F.lit("bit vectors of different lengths")).cast("double")

    def checked(v: Column) -> Column:
        a, b = v["a"], v["b"]
        return (
            F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when(a["n"] == b["n"], of(a["words"], b["words"]))
            .otherwise(wrong)
        )

    return let(F.struct(_col(a).alias("a"), _col(b).alias("b")), checked)


def hamming_distance(a, b) -> Column:
    """Differing bits of two packed vectors."""
    return _distance(a, b, lambda x, y: _bits(x, y, lambda p, q: p.bitwiseXOR(q)).cast("double"))


def jaccard_distance(a, b) -> Column:
    """One minus shared set bits over set bits of either; 1 when nothing is shared."""

    def of(x: Column, y: Column) -> Column:
        both = _bits(x, y, lambda p, q: p.bitwiseAND(q))
        either = _bits(x, y, lambda p, q: p.bitwiseOR(q))
        return let(
            F.struct(both.alias("n"), either.alias("of")),
            lambda v: F.when(v["n"] == 0, F.lit(1.0)).otherwise(F.lit(1.0) - v["n"] / F.when(v["of"] != 0, v["of"])),
        )

    return _distance(a, b, of)
