from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import values
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioseek.operators import ann, query_blocks, search
from folioseek.plans import sizing

DIM = 6


@pytest.fixture(scope="module")
def vectors(spark):
    """300 vectors; a third are copies of one, all of the copies in one document."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        vector = [0.5] * DIM if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(DIM)]
        rows.append((i, 1 if i % 3 == 0 else i, vector))
    return spark.createDataFrame(rows, "id long, doc_id long, embedding array<float>")


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))


def brute(vectors, queries, k):
    rows = [(r["id"], r["embedding"]) for r in vectors.collect()]
    found = []
    for q in queries.collect():
        scored = sorted((math.dist(q["q"], v), i) for i, v in rows)[:k]
        found += [(q["query_id"], rank + 1, i) for rank, (_, i) in enumerate(scored)]
    return sorted(found, key=repr)


def test_block_and_grid_equal_brute_force(vectors, queries):
    expected = brute(vectors, queries, 4)
    assert values(search.exact_top_k(vectors, queries, 4), "query_id", "rank", "id") == expected
    # 300 queries of 48 bytes in cells of 2000: many blocks on both sides.
    grid = search.exact_top_k(vectors, queries, 4, max_query_bytes=2000)
    assert values(grid, "query_id", "rank", "id") == expected


def test_grid_on_a_hot_value(spark, vectors, queries):
    rows = vectors.withColumn("part", F.when(F.col("id") < 200, 1).otherwise(2))
    asked = queries.filter("query_id < 50").withColumn("part", F.explode(F.array(F.lit(1), F.lit(2))))
    found = search.per_query_top(search.by_grid(rows, asked, 3, "l2", 1500, on="part"), "query_id", 3)
    assert values(found, "query_id", "rank", "id") == brute(vectors, queries.filter("query_id < 50"), 3)


def test_salted_status_filter(spark, vectors, monkeypatch):
    sources = spark.createDataFrame([(1, "DONE"), (4, "DONE"), (5, "ERROR")], "doc_id long, status string")
    monkeypatch.setattr(sizing, "fits_broadcast", lambda *a, **k: False)
    kept = search.searchable(vectors, sources)
    assert values(kept, "id") == sorted([(i,) for i in range(0, 300, 3)] + [(1,), (4,)], key=repr)


def test_null_embeddings_and_null_queries_are_left_out(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, q array<float>")
    assert values(search.exact_top_k(rows, asked, 5), "query_id", "id", "score") == [(1, 1, 0.0)]


def test_no_queries(spark, vectors):
    none = spark.createDataFrame([], "query_id long, q array<float>")
    assert search.exact_top_k(vectors, none, 5).count() == 0


def test_wrong_dimension_is_an_error(spark, vectors):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<float>")
    with pytest.raises(PySparkException, match="different vector dimensions"):
        search.exact_top_k(vectors, asked, 5).collect()
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "query_id long, q array<float>")
    with pytest.raises(ValueError, match="different vector dimensions"):
        search.exact_top_k(vectors, mixed, 5)


def test_unknown_metric(vectors, queries):
    with pytest.raises(ValueError, match="unknown metric"):
        search.exact_top_k(vectors, queries, 5, "nearest")


def test_request_validation(spark):
    requests = spark.createDataFrame(
        [(1, " car \n", None), (2, "x", 0), (3, "x", -1), (4, "x", 1), (5, "x", 20), (6, "x", 21), (7, " \t\n ", 3),
         (8, None, 3), (9, " a ", 15)],
        "request_id int, query string, top_k int",
    )
    checked = search.validate_requests(requests)
    assert {r["request_id"]: (r["query"], r["top_k"], r["status"]) for r in checked.collect()} == {
        1: ("car", 5, "OK"), 2: ("x", 5, "OK"), 3: ("x", 5, "OK"), 4: ("x", 1, "OK"), 5: ("x", 20, "OK"),
        6: ("x", 20, "OK"), 7: ("", 3, "BAD_REQUEST"), 8: (None, 3, "BAD_REQUEST"), 9: ("a", 15, "OK"),
    }


def test_search_needs_no_shuffle_of_chunks(spark, sf_dir):
    from folioseek.plans.catalog import QUERIES

    plan = QUERIES["knn_1_exact_top_k"].job(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # The only exchange that moves rows is the merge of per-task hits, by query.
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "query_id" in moved[0]
    assert "SortMergeJoin" not in plan


@pytest.fixture(scope="module")
def lists(spark, vectors):
    centroids = sizing.materialize(ann.train_centroids(vectors, 8), "centroids")
    path = sizing.work_path(spark, "lists")
    ann.write_lists(ann.assign_lists(vectors, centroids), path)
    return path, centroids


def test_assignment_is_nearest(vectors, lists):
    centers = {r["list_id"]: r["centroid"] for r in lists[1].collect()}
    for row in ann.assign_lists(vectors, lists[1]).collect():
        best = min((math.dist(row["embedding"], c), i) for i, c in centers.items())
        assert row["list_id"] == best[1]
        assert row["list_distance"] == pytest.approx(best[0])


def test_all_lists_equal_exact(spark, vectors, queries, lists):
    found = ann.ivf_search(spark, *lists, queries, 4, probes=8)
    assert values(found, "query_id", "rank", "id") == brute(vectors, queries, 4)


def test_list_by_list_way_equals_broadcast_way(spark, queries, lists):
    small = ann.ivf_search(spark, *lists, queries, 4, probes=3)
    large = ann.ivf_search(spark, *lists, queries, 4, probes=3, max_query_bytes=1500)
    assert values(large, "query_id", "rank", "id") == values(small, "query_id", "rank", "id")


def test_only_probed_lists_are_scanned(spark, queries, lists):
    one = queries.filter("query_id = 1")
    plan = ann.ivf_search(spark, *lists, one, 2, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan


def test_recall_grows_to_one(spark, vectors, queries, lists):
    exact = search.exact_top_k(vectors, queries, 4)
    shares = [
        ann.recall(ann.ivf_search(spark, *lists, queries, 4, probes=p), exact).first()["recall"] for p in (1, 8)
    ]
    assert 0 < shares[0] <= shares[1] == 1.0


def test_quantised_search_reranks_exactly(vectors, queries):
    found = search.quantised_search(vectors, queries, 2, oversample=150)
    assert values(found, "query_id", "rank", "id") == brute(vectors, queries, 2)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index_round_trip(spark, vectors, queries, metric):
    path = sizing.work_path(spark, "index")
    ann.build_index(vectors, path, lists=6, metric=metric)
    found = ann.search_index(spark, path, queries, 3, probes=6, metric=metric)
    exact = search.exact_top_k(vectors, queries, 3, metric)
    assert values(found, "query_id", "rank", "id") == values(exact, "query_id", "rank", "id")


def test_few_unfinished_documents_are_broadcast_instead_of_many_finished(spark, tables):
    chunks = spark.createDataFrame(
        [(i, i % 50, [float(i), 1.0]) for i in range(200)], "id long, doc_id long, embedding array<float>"
    )
    sources = spark.createDataFrame([(i, "ERROR" if i == 7 else "DONE") for i in range(49)], "doc_id long, status string")
    want = [(i,) for i in range(200) if i % 50 not in (7, 49)]
    for limit, words in ((10**6, "LeftSemi"), (100, "LeftAnti"), (1, "LeftSemi")):
        df = search.searchable(chunks, sources, limit=limit)
        assert values(df, "id") == sorted(want, key=repr)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert words in plan
        assert ("BroadcastHashJoin" in plan.split(words)[0]) == (limit > 1)


def test_own_k_of_each_query(spark):
    chunks = spark.createDataFrame(
        [(i, 1, 0, "c", [float(i)]) for i in range(80)], "id long, doc_id long, chunk_index int, content string, embedding array<float>"
    )
    sources = spark.createDataFrame([(1, "t", "c", "DONE")], "doc_id long, title string, correspondent string, status string")
    asked = spark.createDataFrame(
        [(1, [0.0], 50), (2, [0.0], None), (3, [0.0], 0), (4, [0.0], 3)], "query_id long, q array<float>, top_k int"
    )
    counts = {r[0]: r[1] for r in search.search(chunks, sources, asked).groupBy("query_id").count().collect()}
    assert counts == {1: 50, 2: 5, 3: 5, 4: 3}


def test_queries_are_evaluated_once(spark):
    calls = spark.sparkContext.accumulator(0)
    chunks = spark.createDataFrame([(1, 1, "c", [1.0])], "id long, doc_id long, content string, embedding array<float>")
    sources = spark.createDataFrame([(1, "t", "c", "DONE")], "doc_id long, title string, correspondent string, status string")

    def embed(parts):
        for b in parts:
            calls.add(b.num_rows)
            yield b

    asked = spark.createDataFrame([(i, [1.0]) for i in range(300)], "query_id long, q array<float>").mapInArrow(
        embed, "query_id long, q array<float>"
    )
    assert search.search(chunks, sources, asked).count() == 300
    assert calls.value == 300


def test_packed_codes_rank_as_sign_bits_do(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, 1.0, 0.0]) for _ in range(70)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v) for i, v in rows[:9]], "query_id long, q array<float>")
    codes = search.write_codes(vectors, sizing.work_path(spark, "codes"))
    found = search.quantised_search(vectors, queries, 4, 3, codes)
    plain = search.exact_top_k(vectors, queries, 12, "hamming")
    want = {(r.query_id, r.id): r.score for r in plain.collect()}
    got = found.collect()
    assert len(got) == 36
    assert all(want[r.query_id, r.id] == r.hamming for r in got)
    with pytest.raises(Exception, match="different numbers of words"):
        short = spark.createDataFrame([(1, [1.0])], "query_id long, q array<float>")
        search.quantised_search(vectors, short, 4, 3, codes).collect()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_query_blocks_leave_the_vectors_where_they_are(spark, vectors, queries):
    stored = sizing.materialize(vectors, "vectors")
    found = search.exact_top_k(stored, queries, 4, max_query_bytes=2000)
    assert values(found, "query_id", "rank", "id") == brute(vectors, queries, 4)
    # the one exchange merges hits; below the job that makes hits, rows come straight from the scan
    above, below = plan_of(found).split("MapInArrow")
    assert above.count("Exchange hashpartitioning(query_id") == 1 and "Exchange" not in below


def test_pieces_of_rows_and_blocks_may_be_small(spark, vectors, queries, monkeypatch):
    path = query_blocks.work_folder(spark)
    query_blocks.write(queries.withColumn("k", F.lit(4)), path, "l2", 300)
    many = query_blocks.scan(vectors, path, "l2", held=200)
    assert values(search.per_query_top(many, "query_id", 4), "query_id", "rank", "id") == brute(vectors, queries, 4)
    held = list(query_blocks.stored(path, "l2"))
    assert len(held) > 50 and sum(len(b.ids) for b in held) == 300


def test_hits_are_merged_in_two_steps(spark, vectors, queries):
    dealt = vectors.repartition(12)
    scanned = query_blocks.scan_sent(dealt, query_blocks.of_table(queries.withColumn("k", F.lit(4)).toArrow(), "l2", 1 << 20))
    found = search.per_query_top(scanned, "query_id", 4, fan_in=3)
    assert values(found, "query_id", "rank", "id") == brute(vectors, queries, 4)
    steps = [line for line in plan_of(found).splitlines() if "Exchange hashpartitioning" in line]
    assert len(steps) == 2 and "_group" in steps[1] and "_group" not in steps[0]
    # of the 12 tasks' 4 hits a query, one task of the first step receives those of 3 at most, the last those of 4 groups
    groups = scanned.withColumn("g", F.floor(F.spark_partition_id() / 3)).groupBy("query_id", "g").count()
    assert groups.agg(F.max("count")).first()[0] <= 12
    assert groups.select("g").distinct().count() == 4


def test_queries_with_many_hits_stand_apart(spark):
    ids, k = np.arange(100), np.array([3] * 98 + [4000, 100_000])
    split = list(query_blocks.split(ids, np.ones((100, 2)), k, "l2", 1 << 16))
    assert sorted(i for b in split for i in b.ids.tolist()) == ids.tolist()
    assert all(len(b.ids) == 1 or len(b.ids) * (16 + 24 * b.k) <= 1 << 16 for b in split)
    assert [b.k for b in split] == [3, 4000, 100_000]


@pytest.mark.parametrize("state", [1 << 28, 100])
def test_hits_that_do_not_fit_a_task_go_by_blocks(spark, vectors, queries, monkeypatch, state):
    monkeypatch.setattr(search, "STATE_BYTES", state)
    found = search.exact_top_k(vectors, queries, 7)
    assert values(found, "query_id", "rank", "id") == brute(vectors, queries, 7)


def test_folders_that_tasks_cannot_open(spark, vectors, queries, monkeypatch):
    assert not query_blocks.readable("viewfs://store/x") and query_blocks.readable("/tmp/x") and query_blocks.readable("file:///tmp/x")
    monkeypatch.setattr(query_blocks, "readable", lambda path: False)
    assert values(search.exact_top_k(vectors, queries, 4, max_query_bytes=2000), "query_id", "rank", "id") == brute(vectors, queries, 4)


def test_probed_lists_prune_the_scan(spark, vectors, queries, lists):
    path, centroids = lists
    one = queries.filter("query_id IN (1, 4)")
    found = ann.ivf_search(spark, path, centroids, one, 3, probes=2, max_query_bytes=100)
    assert "dynamicpruning" in plan_of(found)
    probed = ann.nearest_lists(one, centroids, 2).select("query_id", "list_id")
    rows = spark.read.parquet(path).select("id", "embedding", "list_id")
    want = []
    for q in one.collect():
        mine = rows.join(probed.filter(F.col("query_id") == q.query_id), "list_id").select("id", "embedding")
        want += brute(mine, one.filter(F.col("query_id") == q.query_id), 3)
    assert values(found, "query_id", "rank", "id") == sorted(want, key=repr)


def test_many_queries_find_their_hits_in_one_task(spark, vectors, queries):
    path = query_blocks.work_folder(spark)
    query_blocks.write_rows(vectors.repartition(7), path, "l2", 9, held=400)
    hits = query_blocks.meet(queries.withColumn("k", F.when(F.col("query_id") % 2 == 0, 9).otherwise(4)), path, "l2", held=3000)
    assert hits.groupBy("query_id").count().agg(F.max("count")).first()[0] == 9  # of 7 tasks with rows, 63 before
    assert values(search.per_query_top(hits, "query_id", 4), "query_id", "rank", "id") == brute(vectors, queries, 4)


def test_stored_rows_keep_the_lowest_of_equal_ones(spark):
    copies = spark.range(5000).select((F.lit(5000) - F.col("id")).alias("id"), F.array(F.lit(1.5), F.lit(2.0)).alias("embedding"))
    others = spark.range(6000, 6003).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("embedding"))
    path = query_blocks.work_folder(spark)
    query_blocks.write_rows(copies.coalesce(1).union(others.coalesce(1)), path, "l2", 3)
    assert sorted(i for b in query_blocks.stored(path, "l2") for i in b.ids.tolist()) == [1, 2, 3, 6000, 6001, 6002]


def test_short_queries_with_many_hits_are_dealt_over_the_tasks(spark, vectors, monkeypatch):
    monkeypatch.setattr(search, "SENT_BYTES", 50_000)  # the queries are 14,400 bytes, their hits 144,000
    asked = vectors.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    stored = []
    monkeypatch.setattr(query_blocks, "write_rows", lambda *a, write=query_blocks.write_rows: stored.append(a) or write(*a))
    found = search.exact_top_k(vectors, asked, 20)
    assert len(stored) == 1 and values(found, "query_id", "rank", "id") == brute(vectors, asked, 20)
