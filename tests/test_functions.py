from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioseek.functions import bits, sparse, text
from folioseek.functions import vectors as vec


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def array(*numbers):
    return F.array(*[F.lit(float(n)).cast("float") for n in numbers])


PAIRWISE = [
    vec.l2_distance, vec.l2_squared_distance, vec.l1_distance, vec.inner_product, vec.negative_inner_product,
    vec.cosine_distance, vec.spherical_distance, vec.add, vec.subtract, vec.multiply,
]


@pytest.mark.parametrize("f", PAIRWISE)
def test_unequal_lengths_are_an_error(spark, f):
    with pytest.raises(PySparkException, match="different vector dimensions"):
        one(spark, x=f(array(1, 2), array(1)))


@pytest.mark.parametrize("f", PAIRWISE)
def test_null_gives_null(spark, f):
    null = F.lit(None).cast("array<float>")
    row = one(spark, a=f(array(1, 2), null), b=f(null, array(1)))
    assert row["a"] is None and row["b"] is None


def test_distances(spark):
    a, b = array(3, 4), array(0, 1)
    row = one(
        spark, l2=vec.l2_distance(a, b), sq=vec.l2_squared_distance(a, b), l1=vec.l1_distance(a, b),
        ip=vec.inner_product(a, b), nip=vec.negative_inner_product(a, b), cos=vec.cosine_distance(a, b),
        sph=vec.spherical_distance(array(1, 0), array(0, 1)), far=vec.spherical_distance(array(2, 0), array(2, 0)),
    )
    assert row["l2"] == pytest.approx(math.sqrt(18)) and row["sq"] == 18 and row["l1"] == 6
    assert row["ip"] == 4 and row["nip"] == -4 and row["cos"] == pytest.approx(1 - 4 / 5)
    assert row["sph"] == pytest.approx(0.5) and row["far"] == 0.0


def test_zero_vectors(spark):
    zero = array(0, 0)
    row = one(spark, cos=vec.cosine_distance(zero, array(1, 2)), unit=vec.normalize(zero), n=vec.norm(zero))
    assert math.isnan(row["cos"]) and row["unit"] == [0.0, 0.0] and row["n"] == 0.0


def test_subvector(spark):
    v = array(1, 2, 3, 4, 5)
    row = one(spark, a=vec.subvector(v, 2, 3), b=vec.subvector(v, -1, 4), c=vec.subvector(v, 4, 10))
    assert row["a"] == [2.0, 3.0, 4.0] and row["b"] == [1.0, 2.0] and row["c"] == [4.0, 5.0]
    for start, count in ((1, 0), (-5, 3)):
        with pytest.raises(ValueError):
            vec.subvector(v, start, count)


def test_compare(spark):
    row = one(
        spark, lt=vec.compare(array(1, 2), array(1, 3)), eq=vec.compare(array(1), array(1)),
        gt=vec.compare(array(1, 2), array(1)), shorter=vec.compare(array(1), array(1, -5)),
    )
    assert (row["lt"], row["eq"], row["gt"], row["shorter"]) == (-1, 0, 1, -1)


def test_to_vector_checks(spark):
    ints = F.array(F.lit(1), F.lit(2))
    assert one(spark, v=vec.to_vector(ints, 2))["v"] == [1.0, 2.0]
    assert one(spark, v=vec.to_vector(F.lit(None).cast("array<int>"), 2))["v"] is None
    with pytest.raises(PySparkException, match="expected 3 dimensions, not 2"):
        one(spark, v=vec.to_vector(ints, 3))
    with pytest.raises(PySparkException, match="null element"):
        one(spark, v=vec.to_vector(F.array(F.lit(1), F.lit(None).cast("int"))))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 130])
def test_packed_bits(spark, n):
    left = [i % 3 == 0 for i in range(n)]
    right = [i % 2 == 0 for i in range(n)]
    df = spark.createDataFrame([(left, right)], "a array<boolean>, b array<boolean>")
    row = df.select(
        F.size(bits.pack("a")["words"]).alias("words"),
        bits.hamming_distance(bits.pack("a"), bits.pack("b")).alias("h"),
        bits.jaccard_distance(bits.pack("a"), bits.pack("b")).alias("j"),
    ).first()
    both = sum(x and y for x, y in zip(left, right))
    either = sum(x or y for x, y in zip(left, right))
    assert row["words"] == -(-n // 64)
    assert row["h"] == sum(x != y for x, y in zip(left, right))
    assert row["j"] == pytest.approx(1 - both / either if both else 1.0)


def test_sparse_against_dense(spark):
    a, b = [0.0, 2.0, 0.0, -1.5, 0.0], [1.0, 0.0, 0.0, 3.0, 0.0]
    df = spark.createDataFrame([(a, b, [0.0] * 5)], "a array<double>, b array<double>, z array<double>")
    m, n, z = sparse.to_sparse("a"), sparse.to_sparse("b"), sparse.to_sparse("z")
    row = df.select(
        m.alias("m"), sparse.to_dense(m).alias("back"), sparse.to_dense(z).alias("zeros"),
        sparse.l2_distance(m, n).alias("l2"), vec.l2_distance("a", "b").alias("dl2"),
        sparse.l1_distance(m, n).alias("l1"), vec.l1_distance("a", "b").alias("dl1"),
        sparse.inner_product(m, n).alias("ip"), vec.inner_product("a", "b").alias("dip"),
        sparse.cosine_distance(m, n).alias("cos"), vec.cosine_distance("a", "b").alias("dcos"),
        sparse.cosine_distance(m, z).alias("nan"), sparse.norm(m).alias("norm"), vec.norm("a").alias("dnorm"),
        sparse.normalize(z).alias("empty"), sparse.compare(m, n).alias("cmp"), sparse.equals(m, m).alias("eq"),
        sparse.inner_product(sparse.to_sparse(F.array(F.lit(1.0), F.lit(0.0))), sparse.to_sparse(F.array(F.lit(0.0), F.lit(1.0)))).alias("none"),
    ).first()
    assert row["m"].asDict() == {"dim": 5, "entries": {2: 2.0, 4: -1.5}} and row["back"] == a and row["zeros"] == [0.0] * 5
    for name in ("l2", "l1", "ip", "cos", "norm"):
        assert row[name] == pytest.approx(row["d" + name])
    assert math.isnan(row["nan"]) and row["empty"].entries == {} and row["cmp"] == -1 and row["eq"] and row["none"] == 0.0


def test_unequal_lengths_are_errors(spark):
    def numbers(*values):
        return F.array(*map(F.lit, values))

    three, five = (bits.pack(numbers(*[True] * n)) for n in (3, 5))
    for distance in (bits.hamming_distance, bits.jaccard_distance):
        with pytest.raises(PySparkException, match="different lengths"):
            one(spark, v=distance(three, five))
    short, long = sparse.to_sparse(numbers(1.0, 0.0)), sparse.to_sparse(numbers(1.0, 0.0, 0.0))
    for distance in (sparse.l2_distance, sparse.inner_product, sparse.l1_distance, sparse.cosine_distance):
        with pytest.raises(PySparkException, match="different dimensions"):
            one(spark, v=distance(short, long))
    with pytest.raises(PySparkException, match="null element"):
        one(spark, v=sparse.to_sparse(F.array(F.lit(1.0), F.lit(None))))


def test_sparse_index_out_of_range(spark):
    with pytest.raises(PySparkException, match="outside"):
        one(spark, v=sparse.to_dense(sparse.sparse(F.create_map(F.lit(4), F.lit(1.0)), 3)))


@pytest.mark.parametrize(
    "value,number",
    [("22", 22), ("+5", 5), ("-7", -7), ("007", 7), (" 7 ", None), ("1.5", None), ("", None), ("not-a-number", None),
     ("2147483647", 2147483647), ("2147483648", None), ("-2147483648", -2147483648), ("+", None), ("1\n", None), (None, None)],
)
def test_to_int_or_null(spark, value, number):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(text.to_int_or_null("v").alias("n")).first()["n"] == number


@pytest.mark.parametrize("value", ["x", " x", "x\n", "\t x \r\n", " x ", "\x1cx"])
def test_trimmed(spark, value):
    assert spark.createDataFrame([(value,)], "v string").select(text.trimmed("v").alias("t")).first()["t"] == "x"


@pytest.mark.parametrize("base", ["https://h", "https://h/", "https://h///"])
def test_document_url(spark, base):
    assert one(spark, u=text.document_url(F.lit(42), base))["u"] == "https://h/documents/42"


@pytest.mark.parametrize("base", ["", "/", "  "])
def test_blank_base_is_refused(spark, base):
    with pytest.raises(ValueError):
        text.document_url("id", base)


def test_render_and_metadata(spark):
    day = F.lit("2024-03-05").cast("date")
    null = F.lit(None).cast("string")
    row = one(
        spark,
        full=text.render_document(F.lit("T"), F.lit("C"), day, F.lit("body"), F.lit("n")),
        bare=text.render_document(null, null, day, F.lit("body"), null),
        meta=text.metadata_map(F.lit(5), null, null, day, F.lit("ann"), F.array(F.lit("a"), F.lit("b"))),
    )
    assert row["full"] == "Title: T\nCorrespondent: C\nDate: 2024-03-05\n\nbody\n\nNote: n\n"
    assert row["bare"] == "Title: (untitled)\nDate: 2024-03-05\n\nbody\n\nNote: (no note)\n"
    assert row["meta"] == {
        "doc_id": "5", "title": "(untitled)", "correspondent_name": "", "document_date": "2024-03-05",
        "owner_username": "ann", "tags": "a,b",
    }
