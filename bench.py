"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores), BENCH_ONLY (comma-separated
name prefixes), BENCH_RUNS (timed runs per query; the best counts, after one untimed warm-up
of the session).
"""

from __future__ import annotations

import json
import os
import time

import pyspark
from pyspark.sql import SparkSession

from folioseek.plans.catalog import QUERIES

HEADLINE = (
    "src_3_decode_vector_text", "snk_3_upsert_state", "snk_5_replace_chunks", "snk_7_json_documents",
    "dq_1_duplicate_keys", "flt_6_batch_lookup", "flt_7_request_validation", "jn_2_join_through_bridge",
    "jn_5_orphans", "agg_1_tags_per_document", "agg_4_vector_avg", "srt_1_newest_first", "srt_2_oldest_candidates",
    "win_1_top_k_per_group", "scl_1_render_document", "vec_1_l2_distance", "vec_6_cosine_distance",
    "vec_14_duplicate_vectors", "vec_16_hamming_distance", "vec_21_sparse_distances", "knn_1_exact_top_k",
    "knn_2_batch_top_k", "knn_3_top_k_cosine", "knn_4_search_by_example", "knn_6_quantised_search",
    "knn_7_nearest_label_centroid", "knn_8_ivf_all_lists", "txt_1_recursive_chunks", "txt_2_window_chunks",
    "txt_4_batch_embedding", "ing_1_documents_view", "ing_2_candidates", "ing_5_ingest_job", "ing_7_orphan_cleanup",
    "str_1_continuous_ingest", "str_3_latest_version",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = tuple(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("folioseek-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in (QUERIES if only else HEADLINE) if not only or n.startswith(only)]
    QUERIES["knn_1_exact_top_k"].job(spark, sf_dir).collect()

    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name].job(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
        "spark": pyspark.__version__,
    }))


if __name__ == "__main__":
    main()
