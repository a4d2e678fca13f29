from __future__ import annotations

import pytest
from conftest import values
from pyspark.sql import functions as F

from folioseek.plans import sizing


@pytest.fixture(scope="module")
def big(spark):
    # Key 1 holds most rows, some keys are null, key 9 has no match.
    return spark.range(600).select(
        "id", F.expr("CASE WHEN id % 3 < 2 THEN 1 WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 9 ELSE id % 4 END AS k").alias("k")
    )


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(0, "zero"), (1, "one"), (2, "two"), (3, "three")], "k long, name string")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("spread", [None, "id"])
def test_salted_join_equals_plain(big, dim, how, spread):
    salted = sizing.lookup_join(big, dim, "k", how, limit=-1, spread=spread)
    assert values(salted) == values(big.join(dim, "k", how).select(*salted.columns))
    assert "_salt" not in salted.columns


def test_salted_join_splits_the_hot_key(big, dim):
    salted = sizing.lookup_join(big.drop("name"), dim, "k", limit=-1, salts=4)
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_hot_and_null_keys_are_spread_over_tasks(spark):
    rows = spark.range(9000).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN NULL ELSE id END AS k").alias("k"))
    dim = spark.range(9000).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {key: spark.conf.get(key) for key in changed}

    def largest_share(df):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        return max(sizes) / sum(sizes)

    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        plain = largest_share(rows.join(dim, "k", "left"))
        salted = largest_share(sizing.lookup_join(rows, dim, "k", limit=-1, spread="id"))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert plain > 0.3 and salted < 0.25


def test_broadcast_within_limit(spark, big):
    small = spark.sql("SELECT * FROM VALUES (1L, 'one') AS t(k, name)")
    plan = sizing.lookup_join(big, small, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_measured_size_overrules_the_estimate(spark, big):
    wide = spark.range(10).join(spark.range(100000).select(F.col("id").alias("other")), F.col("id") == F.col("other"))
    assert sizing.measured_bytes(wide) == 10 * 32
    assert not sizing.fits_broadcast(wide, 400)
    assert sizing.fits_broadcast(wide, 400, measure=True)


def test_unsupported_join(big, dim):
    with pytest.raises(ValueError):
        sizing.lookup_join(big, dim, "k", "full")


def test_collect_bounded(spark):
    assert len(sizing.collect_bounded(spark.range(5), 5)) == 5
    assert sizing.collect_bounded(spark.range(6), 5) is None


@pytest.mark.parametrize("width", [1, 7, 65536])
def test_dense_ids_follow_key_order(spark, width):
    keys = [-20, -3, 0, 5, 6, 13, 14, 200, 1000000]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    numbered = sizing.dense_ids(df, "k", 100, width)
    assert values(numbered, "k", "id") == sorted(((k, 101 + i) for i, k in enumerate(keys)), key=repr)


def test_fill_cores_spreads_small_inputs_only(spark, sf_dir):
    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sizing.fill_cores(small, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    unknown = spark.createDataFrame(small.limit(1).rdd, small.schema)
    assert sizing.fill_cores(unknown, "doc_id") is unknown


def test_materialize_cuts_lineage(spark):
    df = sizing.materialize(spark.range(10).withColumn("x", F.col("id") * 2), "numbers")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan
    assert values(df) == sorted(((i, 2 * i) for i in range(10)), key=repr)


def test_shared_dir_is_the_configured_one(spark):
    class Conf:
        def get(self, key, default=None):
            return "hdfs://folder/checkpoints/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert sizing.shared_dir(Session()) == "hdfs://folder/checkpoints"


def test_stored_tables_are_released_and_shuffles_removed(spark):
    before = spark.conf.get(sizing.SHUFFLE_CLEANUP, None)
    kept = sizing.materialize(spark.range(50).repartition(3, "id"), "kept")
    gone = sizing.materialize(spark.range(50).repartition(3, "id"), "gone")
    assert spark.conf.get(sizing.SHUFFLE_CLEANUP, None) == before
    sizing.release(gone)
    assert kept.count() == 50
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(gone._work_path)


def task_shares(spark, make):
    """Rows of each task of the joined table, without adaptive help."""
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {key: spark.conf.get(key) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        sizes = [r["count"] for r in make().groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return max(sizes) / sum(sizes)


def test_only_hot_keys_are_cut_and_as_far_as_they_need(spark):
    rows = spark.range(8000).select("id", F.expr("CASE WHEN id % 2 = 0 THEN -7 WHEN id % 10 = 1 THEN -8 ELSE id END AS k").alias("k"))
    found = sizing.hot_keys(rows, "k", 16)
    named = {r.h: r.k for r in spark.sql("SELECT xxhash64(k) AS h, k FROM VALUES (-7L), (-8L) t(k)").collect()}
    assert {named[h]: n for h, n in found.items()} == {-7: 32}  # half of all rows; a tenth is below two tasks' share of 16
    found = sizing.hot_keys(rows, "k", 40)
    assert {named[h] for h in found} == {-7, -8} and found[next(h for h in found if named[h] == -8)] == 16
    assert sizing.hot_keys(spark.range(500).withColumnRenamed("id", "k"), "k", 8) == {}
    assert sizing.hot_keys(spark.range(5).select(F.lit(None).cast("long").alias("k")), "k", 8) == {}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_keys_of_many_rows_on_both_sides(spark, how):
    rows = spark.range(400).select("id", F.expr("CASE WHEN id % 4 = 0 THEN 1 WHEN id % 4 = 1 THEN NULL ELSE id END AS k").alias("k"))
    other = spark.range(60).select(F.expr("CASE WHEN id < 5 THEN 1 WHEN id < 9 THEN NULL ELSE id END AS k").alias("k"), F.col("id").alias("o"))
    found = sizing.skew_join(rows, other, "k", how)
    assert values(found, "id", "k", "o") == values(rows.join(other, "k", how), "id", "k", "o")


def test_paths_over_hot_and_null_keys(spark, tables):
    from dataclasses import replace

    from folioseek.sources.tables import join_path

    notes = spark.range(6000).select(
        F.col("id").cast("long"), F.lit("n").alias("note"), F.expr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN NULL ELSE id END").cast("long").alias("document_id")
    )
    docs = tables.documents.limit(0).union(tables.documents.where("id = 1")).unionByName(
        spark.range(2, 6000).select("id"), allowMissingColumns=True
    )
    many = replace(tables, notes=notes, documents=docs)
    plain = join_path(many, "notes", "document")
    assert values(join_path(many, "notes", "document", limit=-1), "notes_id", "document_id") == values(plain, "notes_id", "document_id")
    assert task_shares(spark, lambda: join_path(many, "notes", "document", limit=-1)) < 0.25
