"""Bit maps of 64-bit codes: of a fixed size, and never missing a code that they were made of."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the number of 64-bit slots, if nothing else is said. It does not change results.
SLOT_BITS = 21


def hits(bits: np.ndarray, codes: np.ndarray, slot_bits: int = SLOT_BITS) -> np.ndarray:
    """Whether the bit map may hold each code; it never misses one that it was made of."""
    return (bits[codes >> np.uint64(64 - slot_bits)] >> (codes & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_map(codes: DataFrame, name: str, slot_bits: int = SLOT_BITS) -> np.ndarray:
    """Bits of the column ``name``, of a size that does not depend on its rows."""
    slot, bit = F.shiftrightunsigned(name, 64 - slot_bits).alias("slot"), F.expr(f"shiftleft(1L, cast({name} & 63 as int))")
    rows = codes.groupBy(slot).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << slot_bits, np.uint64)
    bits[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return bits
