from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioseek.operators import aggregates


def test_vectors_are_folded_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 50 == 0 else i % 3, rng.standard_normal(5).tolist() if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g int, embedding array<float>").repartition(6)
    for fold, combine in ((aggregates.vector_avg, np.mean), (aggregates.vector_sum, np.sum)):
        found = {r[0]: r[1] for r in fold(df, "g").collect()}
        assert set(found) == {None, 0, 1, 2}
        for g, v in found.items():
            own = np.array([np.array(r[2], np.float32) for r in rows if r[1] == g and r[2] is not None], np.float64)
            assert np.allclose(v, combine(own, axis=0), rtol=1e-12)
        plan = fold(df, "g")._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "partial_" in plan


def test_groups_without_a_vector_and_unequal_widths(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, 2.0]), (2, [1.0])], "g int, embedding array<float>")
    assert aggregates.vector_avg(df.where("g = 1"), "g").collect() == []
    with pytest.raises(Exception, match="Dimensions mismatch"):
        aggregates.vector_avg(df.where(F.col("g") == 2).coalesce(1), "g").collect()
