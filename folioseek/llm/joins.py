"""Joins with lookup tables whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.plans.sizing import fits_broadcast

#: Largest lookup table that is broadcast, as ``measured_bytes`` counts it; hashed it takes a few times that.
BROADCAST_BYTES = 4 << 20


def lookup(big: DataFrame, dim: DataFrame, key: str, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``big`` to ``dim``, which has each ``key`` once.

    Within ``limit`` ``dim`` is broadcast and ``big`` is not moved. Beyond it both are shuffled
    by the key; a hot key of ``big`` is then a skewed partition, which adaptive execution splits.
    """
    return big.join(F.broadcast(dim) if fits_broadcast(dim, limit, measure=True) else dim, key, how)
