"""Vector column operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioseek.functions import bits, sparse
from folioseek.functions import vectors as vec
from folioseek.operators import aggregates
from folioseek.plans import sizing
from folioseek.plans.registry import query
from folioseek.plans.views import EXAMPLE, base

# x: the row's vector, q: the example's vector, both in double.
PAIRS = f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
  p AS (SELECT vec_id, x, (SELECT x FROM e WHERE vec_id = {EXAMPLE}) AS q FROM e)"""


def pairs(spark, sf) -> DataFrame:
    """Every vector beside the example vector, fetched once as a scalar."""
    emb = base(spark, sf, "embeddings")
    example = emb.filter(F.col("vec_id") == EXAMPLE).select("embedding").scalar()
    return emb.select("vec_id", "label", F.col("embedding").alias("x"), example.alias("q"))


def elements(df: DataFrame, vector, key: str = "vec_id") -> DataFrame:
    """One rounded row per element of a vector column."""
    return df.select(key, F.posexplode(vector).alias("pos", "v")).select(
        key, "pos", F.round(F.col("v").cast("double"), 6).alias("v")
    )


def elements_sql(vector: str, source: str = "p", key: str = "vec_id") -> str:
    return f"""SELECT {key}, CAST(i - 1 AS INT) AS pos, round(w[i]::DOUBLE, 6) AS v
      FROM (SELECT {key}, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT {key}, {vector} AS w FROM {source}))"""


DISTANCE_SQL = {
    "vec_1_l2_distance": ("list_distance(x, q)", vec.l2_distance),
    "vec_2_l2_squared_distance": ("list_sum(list_transform(x, lambda a, i: (a - q[i]) * (a - q[i])))", vec.l2_squared_distance),
    "vec_3_l1_distance": ("list_sum(list_transform(x, lambda a, i: abs(a - q[i])))", vec.l1_distance),
    "vec_4_inner_product": ("list_inner_product(x, q)", vec.inner_product),
    "vec_5_negative_inner_product": ("-list_inner_product(x, q)", vec.negative_inner_product),
    "vec_6_cosine_distance": ("list_cosine_distance(x, q)", vec.cosine_distance),
    "vec_7_spherical_distance": ("acos(greatest(least(list_inner_product(x, q), 1.0), -1.0)) / pi()", vec.spherical_distance),
}


def _register_distances() -> None:
    for name, (sql, distance) in DISTANCE_SQL.items():
        def job(spark, sf, distance=distance):
            score = F.round(distance("x", "q"), 6) + F.lit(0.0)
            return pairs(spark, sf).select("vec_id", score.alias("score"))

        query(name, f"{PAIRS} SELECT vec_id, round({sql}, 6) + 0.0 AS score FROM p")(job)


_register_distances()


@query("vec_8_norm", f"{PAIRS} SELECT vec_id, round(sqrt(list_inner_product(x, x)), 6) AS norm FROM p")
def _(spark, sf):
    return pairs(spark, sf).select("vec_id", F.round(vec.norm("x"), 6).alias("norm"))


@query(
    "vec_9_normalize",
    f"""{PAIRS}, s AS (SELECT vec_id, list_transform(x, lambda a: a * 3 + 1) AS y FROM p)
    {elements_sql('list_transform(y, lambda a: a / sqrt(list_inner_product(y, y)))', 's')}""",
)
def _(spark, sf):
    shifted = pairs(spark, sf).select("vec_id", F.transform("x", lambda a: a.cast("double") * 3 + 1).alias("y"))
    return elements(shifted.select("vec_id", F.transform("y", lambda a: a).alias("y")), vec.normalize("y"))


@query(
    "vec_10_add_subtract_multiply",
    f"""{PAIRS}, r AS (SELECT vec_id, x, q, unnest(generate_series(1, len(x))) AS i FROM p)
    SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(x[i] + q[i], 6) AS added, round(x[i] - q[i], 6) AS subtracted,
      round(x[i] * q[i], 6) + 0.0 AS multiplied FROM r""",
)
def _(spark, sf):
    merged = F.arrays_zip(
        vec.add("x", "q").alias("a"), vec.subtract("x", "q").alias("s"), vec.multiply("x", "q").alias("m")
    )
    rows = pairs(spark, sf).select("vec_id", merged.alias("z")).select("vec_id", F.posexplode("z").alias("pos", "z"))
    return rows.select(
        "vec_id", "pos", F.round("z.a", 6).alias("added"), F.round("z.s", 6).alias("subtracted"),
        (F.round("z.m", 6) + F.lit(0.0)).alias("multiplied"),
    )


@query(
    "vec_10_center_on_label_mean",
    """WITH r AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
    SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(x[i] - avg(x[i]) OVER (PARTITION BY label, i), 6) + 0.0 AS v FROM r""",
)
def _(spark, sf):
    emb = base(spark, sf, "embeddings")
    means = aggregates.vector_avg(emb, "label")
    joined = sizing.lookup_join(emb, means, "label", spread="vec_id", measure=True)
    rows = elements(joined, vec.subtract("embedding", "centroid"))
    return rows.withColumn("v", F.col("v") + F.lit(0.0))


@query("vec_11_concat", f"{PAIRS} {elements_sql('list_concat(x, q)')}")
def _(spark, sf):
    return elements(pairs(spark, sf), vec.concat("x", "q"))


@query("vec_12_subvector", f"{PAIRS} {elements_sql('x[3:12]')}")
def _(spark, sf):
    return elements(pairs(spark, sf), vec.subvector("x", 3, 10))


@query("vec_13_dims", "SELECT vec_id, CAST(len(embedding) AS INT) AS dims FROM embeddings")
def _(spark, sf):
    return base(spark, sf, "embeddings").select("vec_id", vec.dims("embedding").alias("dims"))


@query(
    "vec_14_compare",
    f"""{PAIRS} SELECT vec_id, CASE WHEN x < q THEN -1 WHEN x = q THEN 0 ELSE 1 END AS cmp, x = q AS eq, x <> q AS ne,
      x < q AS lt, x <= q AS le, x >= q AS ge, x > q AS gt FROM p""",
)
def _(spark, sf):
    x, q = F.col("x"), F.col("q")
    return pairs(spark, sf).select(
        "vec_id", vec.compare("x", "q").alias("cmp"), (x == q).alias("eq"), (x != q).alias("ne"), (x < q).alias("lt"),
        (x <= q).alias("le"), (x >= q).alias("ge"), (x > q).alias("gt"),
    )


@query(
    "vec_14_duplicate_vectors",
    """WITH r AS (SELECT l_orderkey, l_linenumber, [l_linenumber, l_quantity, l_tax]::FLOAT[] AS v FROM lineitem)
    SELECT min(l_orderkey) AS first_id, count(*) AS copies FROM r GROUP BY v HAVING count(*) > 1""",
)
def _(spark, sf):
    parts = F.array(*[F.col(c).cast("float") for c in ("l_linenumber", "l_quantity", "l_tax")])
    rows = base(spark, sf, "lineitem").select("l_orderkey", parts.alias("v"))
    return aggregates.duplicate_vectors(rows, "l_orderkey", "v")


@query(
    "vec_15_binary_quantize",
    f"""{PAIRS} SELECT vec_id, list_aggregate(list_transform(x, lambda a: CASE WHEN a > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM p""",
)
def _(spark, sf):
    text = F.transform(bits.binary_quantize("x"), lambda b: F.when(b, F.lit("1")).otherwise(F.lit("0")))
    return pairs(spark, sf).select("vec_id", F.array_join(text, "").alias("bits"))


def packed_pairs(spark, sf) -> DataFrame:
    pair = pairs(spark, sf)
    return pair.select(
        "vec_id", bits.pack(bits.binary_quantize("x")).alias("bx"), bits.pack(bits.binary_quantize("q")).alias("bq")
    )


@query(
    "vec_16_hamming_distance",
    f"""{PAIRS} SELECT vec_id, list_sum(list_transform(x, lambda a, i: CASE WHEN (a > 0) <> (q[i] > 0) THEN 1.0::DOUBLE ELSE 0.0 END)) AS score FROM p""",
)
def _(spark, sf):
    return packed_pairs(spark, sf).select("vec_id", bits.hamming_distance("bx", "bq").alias("score"))


@query(
    "vec_17_jaccard_distance",
    f"""{PAIRS}, c AS (SELECT vec_id,
        list_sum(list_transform(x, lambda a, i: CASE WHEN a > 0 AND q[i] > 0 THEN 1 ELSE 0 END)) AS both_set,
        list_sum(list_transform(x, lambda a, i: CASE WHEN a > 0 OR q[i] > 0 THEN 1 ELSE 0 END)) AS either_set FROM p)
    SELECT vec_id, round(CASE WHEN both_set = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - both_set / either_set::DOUBLE END, 6) AS score FROM c""",
)
def _(spark, sf):
    return packed_pairs(spark, sf).select("vec_id", F.round(bits.jaccard_distance("bx", "bq"), 6).alias("score"))


@query(
    "vec_18_array_to_vector",
    f"""WITH s AS (SELECT o_orderkey, [o_custkey::FLOAT::DOUBLE, o_totalprice::FLOAT::DOUBLE, 0.5] AS w FROM orders)
    {elements_sql('w', 's', 'o_orderkey')}""",
)
def _(spark, sf):
    numbers = F.array(F.col("o_custkey").cast("double"), "o_totalprice", F.lit(0.5))
    rows = base(spark, sf, "orders").select("o_orderkey", vec.to_vector(numbers, 3).alias("w"))
    return elements(rows, "w", "o_orderkey")


@query("vec_19_vector_to_array", f"{PAIRS} {elements_sql('x')}")
def _(spark, sf):
    rows = pairs(spark, sf)
    dim = rows.select(F.size("x").alias("n")).first()["n"]
    return elements(rows, vec.to_array(vec.to_vector("x", dim)))


# --- sparse vectors: hashed word counts of every document, against those of one item -------

SPARSE_DIM = 64
SPARSE = f"""WITH w AS (SELECT doc_id AS vec_id, unnest(string_split(text, ' ')) AS word FROM documents),
  g AS (SELECT vec_id, CAST(1 + (length(word) * 7 + ascii(word)) % {SPARSE_DIM} AS INT) AS dim, count(*)::DOUBLE AS value FROM w GROUP BY ALL),
  k AS (SELECT min(vec_id) AS least FROM g),
  n AS (SELECT vec_id, list_transform(generate_series(1, {SPARSE_DIM}), lambda i: coalesce(map(list(dim), list(value))[CAST(i AS INT)], 0.0)) AS x FROM g GROUP BY vec_id),
  s AS (SELECT vec_id, x, (SELECT x FROM n, k WHERE vec_id = least) AS q FROM n)"""


def sparse_rows(spark, sf, docs: DataFrame | None = None) -> DataFrame:
    """``(vec_id, x)``: naturally sparse vectors, built from their entries without a dense form."""
    docs = base(spark, sf, "documents") if docs is None else docs
    words = docs.select(F.col("doc_id").alias("vec_id"), F.explode(F.split("text", " ")).alias("w"))
    slot = (1 + (F.length("w") * 7 + F.ascii("w")) % SPARSE_DIM).cast("int")
    counts = words.groupBy("vec_id", slot.alias("dim")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    entries = counts.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
    return entries.select("vec_id", sparse.sparse("m", SPARSE_DIM).alias("x"))


def sparse_pairs(spark, sf) -> DataFrame:
    """Every vector beside that of the first document with a text, which alone is read for it."""
    docs = base(spark, sf, "documents").filter(F.col("text").isNotNull())
    first = docs.filter(F.col("doc_id") == docs.agg(F.min("doc_id")).scalar())
    return sparse_rows(spark, sf).withColumn("q", sparse_rows(spark, sf, first).agg(F.min_by("x", "vec_id")).scalar())


@query(
    "vec_20_dense_to_sparse",
    f"""{SPARSE}, r AS (SELECT vec_id, x, unnest(generate_series(1, len(x))) AS i FROM s)
    SELECT vec_id, CAST(i AS INT) AS dim, x[i] AS value FROM r WHERE x[i] <> 0""",
)
def _(spark, sf):
    dense = sparse_rows(spark, sf).select("vec_id", sparse.to_dense("x").alias("x"))
    return sparse.to_long(dense.select("vec_id", sparse.to_sparse("x").alias("x")), "vec_id", "x")


@query("vec_20_sparse_to_dense", f"{SPARSE} {elements_sql('x', 's')}")
def _(spark, sf):
    return elements(sparse_rows(spark, sf), sparse.to_dense("x"))


@query(
    "vec_21_sparse_distances",
    f"""{SPARSE} SELECT vec_id, round(list_distance(x, q), 6) AS l2,
      round(list_sum(list_transform(x, lambda a, i: (a - q[i]) * (a - q[i]))), 6) AS l2_squared,
      round(list_sum(list_transform(x, lambda a, i: abs(a - q[i]))), 6) AS l1,
      round(list_inner_product(x, q), 6) + 0.0 AS inner_product, round(-list_inner_product(x, q), 6) + 0.0 AS negative_inner,
      round(list_cosine_distance(x, q), 6) + 0.0 AS cosine FROM s""",
)
def _(spark, sf):
    found = sparse_pairs(spark, sf).select("vec_id", sparse.distances("x", "q").alias("d"))
    names = ("l2", "l2_squared", "l1", "inner_product", "negative_inner", "cosine")
    return found.select("vec_id", *[(F.round(F.col(f"d.{name}"), 6) + F.lit(0.0)).alias(name) for name in names])


@query(
    "vec_22_sparse_norm_and_normalize",
    f"""{SPARSE}, r AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS norm, unnest(generate_series(1, len(x))) AS i FROM s)
    SELECT vec_id, round(norm, 6) AS norm, CAST(i AS INT) AS dim, round(x[i] / norm, 6) AS value FROM r WHERE x[i] <> 0""",
)
def _(spark, sf):
    rows = sparse_rows(spark, sf).select("vec_id", F.round(sparse.norm("x"), 6).alias("norm"), sparse.normalize("x").alias("x"))
    return rows.select("vec_id", "norm", F.explode("x.entries").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query(
    "vec_23_sparse_compare",
    f"""{SPARSE} SELECT vec_id, x = q AS eq, CASE WHEN x < q THEN -1 WHEN x = q THEN 0 ELSE 1 END AS cmp FROM s""",
)
def _(spark, sf):
    return sparse_pairs(spark, sf).select("vec_id", sparse.equals("x", "q").alias("eq"), sparse.compare("x", "q").alias("cmp"))


# --- vector aggregates -----------------------------------------------------------------


def _aggregate_sql(function: str) -> str:
    return f"""WITH r AS (SELECT label, embedding::DOUBLE[] AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
    SELECT label, CAST(i - 1 AS INT) AS pos, round({function}(x[i]), 6) + 0.0 AS v FROM r GROUP BY label, i"""


def _aggregated(vectors: DataFrame, into: str) -> DataFrame:
    return elements(vectors, into, "label").withColumn("v", F.col("v") + F.lit(0.0))


@query("agg_4_vector_avg", _aggregate_sql("avg"))
def _(spark, sf):
    return _aggregated(aggregates.vector_avg(base(spark, sf, "embeddings"), "label"), "centroid")


@query("agg_5_vector_sum", _aggregate_sql("sum"))
def _(spark, sf):
    return _aggregated(aggregates.vector_sum(base(spark, sf, "embeddings"), "label"), "total")


# --- user-defined expressions ----------------------------------------------------------


@query(
    "udf_4_sql_expression",
    f"{PAIRS} SELECT vec_id, round(list_distance(x, q), 6) AS score FROM p",
)
def _(spark, sf):
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION folioseek_l2(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE
        RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> power(CAST(x AS DOUBLE) - CAST(y AS DOUBLE), 2)), 0D, (s, v) -> s + v))"""
    )
    return pairs(spark, sf).select("vec_id", F.expr("round(folioseek_l2(x, q), 6)").alias("score"))
