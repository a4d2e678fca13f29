"""Nearest-neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.functions import vectors
from folioseek.functions.vectors import DISTANCES
from folioseek.operators import aggregates, ann, search
from folioseek.plans import sizing
from folioseek.plans.registry import query
from folioseek.plans.views import EXAMPLE, base, document_tables

HIT_SQL = """h.id, h.doc_id, h.title, h.correspondent AS correspondent_name, h.content AS snippet,
  concat('http://localhost:8000/documents/', CAST(h.doc_id AS VARCHAR)) AS source_url"""


def all_queries(spark, sf) -> DataFrame:
    """Every stored vector as a query."""
    return base(spark, sf, "embeddings").selectExpr("vec_id AS query_id", "embedding AS q")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"score": F.round("score", 6) + F.lit(0.0), "rank": F.col("rank").cast("long")})


def ranked_sql(score: str, k: str, queries: str = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings") -> str:
    """CTEs ending in ``h``: the hits of a batch of queries."""
    return f"""WITH q AS ({queries}),
    s AS (SELECT q.query_id, k.*, {score} AS score FROM q, v_searchable k),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s),
    h AS (SELECT * FROM r WHERE rank <= {k})"""


@query(
    "knn_1_exact_top_k",
    f"""WITH h AS (SELECT *, list_distance(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {EXAMPLE})) AS score
      FROM v_searchable ORDER BY score, id LIMIT 5)
    SELECT {HIT_SQL}, round(h.score, 6) AS score FROM h""",
    "v_searchable",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    asked = all_queries(spark, sf).filter(F.col("query_id") == EXAMPLE)
    hits = search.search(t.chunks, t.sources, asked, 5)
    return rounded(hits).drop("query_id", "rank")


@query(
    "knn_2_batch_top_k",
    f"""{ranked_sql('list_distance(k.v, q.q)', '20')},
    asked AS (SELECT vec_id AS query_id, least(coalesce(CASE WHEN label > 0 THEN label END, 5), 20) AS top_k FROM embeddings)
    SELECT h.query_id, h.rank, h.id, h.doc_id, h.title, h.correspondent AS correspondent_name, h.content AS snippet,
      round(h.score, 6) AS score, concat('http://localhost:8000/documents/', CAST(h.doc_id AS VARCHAR)) AS source_url
    FROM h JOIN asked ON h.query_id = asked.query_id WHERE h.rank <= asked.top_k""",
    "v_searchable",
)
def _(spark, sf):
    from folioseek.functions.text import clamped_top_k

    t = document_tables(spark, sf)
    asked = base(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), clamped_top_k("label").alias("top_k")
    )
    return rounded(search.search(t.chunks, t.sources, asked))


@query(
    "knn_2_own_k_above_20",
    f"""{ranked_sql('list_distance(k.v, q.q)', '60')},
    asked AS (SELECT vec_id AS query_id, CASE WHEN label = 0 THEN 5 ELSE 6 * label END AS top_k FROM embeddings)
    SELECT h.query_id, h.rank, h.id, round(h.score, 6) AS score
    FROM h JOIN asked ON h.query_id = asked.query_id WHERE h.rank <= asked.top_k""",
    "v_searchable",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    asked = base(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), (6 * F.col("label")).alias("top_k")
    )
    return rounded(search.search(t.chunks, t.sources, asked)).select("query_id", "rank", "id", "score")


@query(
    "knn_2_batch_top_k_by_grid",
    f"{ranked_sql('list_distance(k.v, q.q)', '3')} SELECT query_id, rank, id, round(score, 6) AS score FROM h",
    "v_searchable",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    # A byte bound far below the query set takes the hash-partitioned way.
    found = search.exact_top_k(
        search.searchable(t.chunks, t.sources), all_queries(spark, sf), 3, max_query_bytes=64 * 1024
    )
    return rounded(found)


METRIC_SQL = {
    "cosine": "list_cosine_distance(k.v, q.q)",
    "inner": "-list_inner_product(k.v, q.q)",
    "l1": "list_sum(list_transform(k.v, lambda a, i: abs(a - q.q[i])))",
    "spherical": "acos(greatest(least(list_inner_product(k.v, q.q), 1.0), -1.0)) / pi()",
}


def _register_metrics() -> None:
    for metric, score in METRIC_SQL.items():
        def job(spark, sf, metric=metric):
            t = document_tables(spark, sf)
            found = search.exact_top_k(search.searchable(t.chunks, t.sources), all_queries(spark, sf), 5, metric)
            return rounded(found)

        query(
            f"knn_3_top_k_{metric}",
            f"{ranked_sql(score, '5')} SELECT query_id, rank, id, round(score, 6) + 0.0 AS score FROM h",
            "v_searchable",
        )(job)


_register_metrics()


@query(
    "knn_3_metric_expression",
    f"""WITH h AS (SELECT id, list_cosine_distance(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {EXAMPLE})) AS score
      FROM v_searchable) SELECT id, round(score, 6) AS score FROM h""",
    "v_searchable",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    example = all_queries(spark, sf).filter(F.col("query_id") == EXAMPLE).select("q").scalar()
    rows = search.searchable(t.chunks, t.sources).withColumn("q", example)
    return rows.select("id", F.round(DISTANCES["cosine"]("embedding", "q"), 6).alias("score"))


@query(
    "knn_4_search_by_example",
    f"""{ranked_sql('list_distance(k.v, q.q)', '15', "SELECT id AS query_id, v AS q, doc_id AS own FROM v_searchable")}
    SELECT h.query_id, max(CASE WHEN h.doc_id = o.doc_id THEN 1 ELSE 0 END) AS found_own,
      CAST(max(CASE WHEN h.rank = 1 AND h.id = h.query_id THEN 1 ELSE 0 END) AS INT) AS self_first
    FROM h JOIN v_searchable o ON o.id = h.query_id GROUP BY h.query_id""",
    "v_searchable",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    live = search.searchable(t.chunks, t.sources)
    found = search.exact_top_k(live, search.example_queries(live), 15)
    doc_of = live.select("id", "doc_id")
    hits = found.join(doc_of, "id").join(
        doc_of.select(F.col("id").alias("query_id"), F.col("doc_id").alias("own")), "query_id"
    )
    own = F.when(F.col("doc_id") == F.col("own"), 1).otherwise(0)
    self_first = F.when((F.col("rank") == 1) & (F.col("id") == F.col("query_id")), 1).otherwise(0)
    return hits.groupBy("query_id").agg(F.max(own).alias("found_own"), F.max(self_first).alias("self_first"))


@query(
    "knn_5_hit_shaping",
    f"""{ranked_sql('list_distance(k.v, q.q)', '2')}
    SELECT h.query_id, h.rank, {HIT_SQL}, round(h.score, 6) AS score FROM h""",
    "v_searchable",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    found = search.exact_top_k(search.searchable(t.chunks, t.sources), all_queries(spark, sf), 2)
    return rounded(search.shape_hits(found, t.chunks, t.sources))


@query(
    "knn_6_quantised_search",
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings),
    s AS (SELECT q.query_id, q.q, k.id, k.v,
            list_sum(list_transform(k.v, lambda a, i: CASE WHEN (a > 0) <> (q.q[i] > 0) THEN 1.0::DOUBLE ELSE 0.0 END)) AS hamming
          FROM q, v_searchable k),
    short AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hamming, id) AS place FROM s),
    r AS (SELECT query_id, id, hamming, list_distance(v, q) AS score FROM short WHERE place <= 20),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM r)
    SELECT query_id, id, hamming, round(score, 6) AS score, rank FROM t WHERE rank <= 5""",
    "v_searchable",
)
def _(spark, sf):
    t = document_tables(spark, sf)
    return rounded(search.quantised_search(search.searchable(t.chunks, t.sources), all_queries(spark, sf), 5, 4))


@query(
    "knn_7_nearest_label_centroid",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings),
    m AS (SELECT label, i, avg(v[i]) AS a FROM e GROUP BY label, i),
    c AS (SELECT label, list(a ORDER BY i) AS c FROM m GROUP BY label),
    s AS (SELECT x.vec_id, c.label AS list_id, list_distance(x.embedding::DOUBLE[], c.c) AS d FROM embeddings x, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, list_id) AS place FROM s)
    SELECT vec_id, list_id, round(d, 6) AS list_distance FROM r WHERE place = 1""",
)
def _(spark, sf):
    emb = base(spark, sf, "embeddings")
    centroids = aggregates.vector_avg(emb, "label").withColumnRenamed("label", "list_id")
    assigned = ann.assign_lists(emb.select("vec_id", "embedding"), centroids)
    return assigned.select("vec_id", "list_id", F.round("list_distance", 6).alias("list_distance"))


@query("knn_7_kmeans_assignment")
def _(spark, sf):
    emb = base(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return ann.assign_lists(emb, ann.train_centroids(emb, lists=20)).select("id", "list_id", "list_distance")


@query(
    "knn_7_vectors_in_another_list",
    "SELECT count(*) AS vectors, CAST(0 AS BIGINT) AS elsewhere FROM embeddings WHERE embedding IS NOT NULL",
)
def _(spark, sf):
    """Of all vectors those whose k-means list is not the nearest, by distances to every centroid as expressions."""
    emb = base(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    centroids = sizing.materialize(ann.train_centroids(emb, lists=20), "centroids")
    every = centroids.agg(F.collect_list(F.struct("list_id", "centroid"))).scalar()  # 20 rows
    away = F.transform(F.col("every"), lambda c: vectors.l2_distance("embedding", c["centroid"]))
    judged = ann.assign_lists(emb, centroids).withColumn("every", every).withColumn("nearest", F.array_min(away))
    return judged.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count(F.when(F.col("list_distance") > F.col("nearest") + 1e-9, 1)).alias("elsewhere"),
    )


def stored_lists(spark, sf, lists: int = ann.LISTS) -> str:
    """Searchable chunks stored by list in the shared folder."""
    t = document_tables(spark, sf)
    path = sizing.work_path(spark, "lists")
    ann.build_index(search.searchable(t.chunks, t.sources), path, lists)
    return path


@query(
    "knn_8_ivf_all_lists",
    f"{ranked_sql('list_distance(k.v, q.q)', '5')} SELECT query_id, rank, id, round(score, 6) AS score FROM h",
    "v_searchable",
)
def _(spark, sf):
    return rounded(ann.search_index(spark, stored_lists(spark, sf), all_queries(spark, sf), 5, probes=ann.LISTS))


@query("knn_8_ivf_recall")
def _(spark, sf):
    path = stored_lists(spark, sf, 25)
    t = document_tables(spark, sf)
    exact = search.exact_top_k(search.searchable(t.chunks, t.sources), all_queries(spark, sf), 5)
    return ann.recall(ann.search_index(spark, path, all_queries(spark, sf), 5, probes=8), exact)
