from __future__ import annotations

import json

import pytest
from conftest import values

from folioseek.plans import sizing
from folioseek.sources import json_sink, vector_text
from folioseek.sources.schemas import SCHEMAS
from folioseek.sources.tables import conform, jdbc_options, load_tables, read_parquet


def test_decode(spark):
    texts = ["[1.5,2,-3e-2]", "[1, 2]", None, "[]", "[a]", "1,2", "[1,,2]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, v string")
    good, bad = vector_text.decode(rows, "v")
    decoded = {r["id"]: r["embedding"] for r in good.collect()}
    assert decoded[0] == pytest.approx([1.5, 2.0, -0.03]) and decoded[1] == [1.0, 2.0]
    assert decoded[2] == [] and decoded[5] == [1.0, 2.0]
    assert values(bad, "id") == [(3,), (4,), (6,)]


def test_round_trip(spark):
    rows = spark.createDataFrame([(1, [0.1, -2.0, 3e-9])], "id int, e array<float>")
    assert rows.select(vector_text.encode("e").alias("v")).first()["v"] == "[0.1, -2.0, 3.0E-9]"
    back, _ = vector_text.decode(rows.select("id", vector_text.encode("e").alias("v")), "v")
    assert back.first()["embedding"] == rows.first()["e"]


def test_json(spark, tables):
    rows = json_sink.to_json_rows(tables.users.orderBy("id")).collect()
    assert [json.loads(r["json"]) for r in rows] == [{"id": 100, "username": "ann"}, {"id": 101, "username": "bob"}]
    path = sizing.work_path(spark, "json")
    json_sink.write_json(tables.tags, path)
    assert spark.read.json(path).count() == 5
    assert spark.read.text(path).filter("value LIKE '%\"name\":null%'").count() == 1


def test_jdbc_options():
    found = jdbc_options("jdbc:x", "documents", "id", (1, 1000), 16, user="u")
    assert found["partitionColumn"] == "id" and found["numPartitions"] == "16" and found["upperBound"] == "1000"
    assert "partitionColumn" not in jdbc_options("jdbc:x", "documents")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "documents", key="id")


def test_load_tables_prunes_and_renames(spark, tables):
    root = sizing.work_path(spark, "tables")
    for name in SCHEMAS:
        getattr(tables, name).write.parquet(f"{root}/{'doc' if name == 'documents' else name}")
    loaded = load_tables(spark, root, {"documents": "doc"})
    assert values(loaded.documents) == values(tables.documents)
    renamed = read_parquet(spark, f"{root}/users", columns={"username": "login"})
    assert renamed.columns == ["id", "login"]
    with pytest.raises(ValueError, match="username"):
        conform(renamed, SCHEMAS["users"])


def test_scan_reads_needed_columns_and_pushes_filters(spark, sf_dir):
    from folioseek.plans.catalog import QUERIES

    def plan(name):
        return QUERIES[name].job(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in plan("src_1_table_scan")
    filtered = plan("flt_2_condition_list")
    pushed, schema = filtered.split("PushedFilters:")[1].split("ReadSchema")
    assert "(lang,en)" in pushed and "GreaterThan(n_chars" in pushed
    assert "text" not in schema


def test_missing_columns_are_errors_but_for_optional_ones(spark):
    bad = spark.createDataFrame([(1, "x")], "id long, titel string")
    with pytest.raises(ValueError, match="title"):
        conform(bad, SCHEMAS["documents"])


def test_text_vectors_are_read(spark):
    schema = "id long, doc_id long, chunk_index int, content string, embedding string"
    rows = [(1, 1, 0, "a", "[1, 2.5,-3]"), (2, 1, 1, "b", None)]
    read = conform(spark.createDataFrame(rows, schema), SCHEMAS["chunks"])
    assert [r.embedding for r in read.orderBy("id").collect()] == [[1.0, 2.5, -3.0], None]
    wrong = spark.createDataFrame([(1, 1, 0, "a", "[1, x]")], schema)
    with pytest.raises(Exception, match="not a vector"):
        conform(wrong, SCHEMAS["chunks"]).collect()
