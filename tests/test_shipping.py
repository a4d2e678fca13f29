"""Python workers find the package although the driver was started elsewhere."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from folioseek.operators import search
from folioseek.plans import shipping
if {zipped}:
    shipping.add_zip(spark)
    shipping._shipped.add(spark.sparkContext.applicationId)
rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], "id long, embedding array<float>")
asked = spark.createDataFrame([(1, [0.0, 0.9])], "query_id long, q array<float>")
print("nearest", search.exact_top_k(rows, asked, 1).first()["id"])
"""


@pytest.mark.parametrize("zipped", [False, True])
def test_workers_import_the_package(tmp_path, zipped):
    script = SCRIPT.format(repo=str(REPO), zipped=zipped)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "nearest 1" in done.stdout, done.stderr[-2000:]
