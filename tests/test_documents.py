from __future__ import annotations

import pytest
from conftest import at, values
from pyspark.sql import functions as F

from folioseek.operators import documents
from folioseek.plans import sizing
from folioseek.sources.tables import join_path


def test_view(tables):
    rows = documents.documents_view(tables).collect()
    # Newest first, a missing time before all others, ties by id; the PNG is not listed.
    assert [r["id"] for r in rows] == [5, 1, 4, 2]
    by_id = {r["id"]: r for r in rows}
    assert by_id[1]["tags"] == ["a", "b", "b"] and by_id[2]["tags"] == [] and by_id[4]["tags"] == ["c"]
    assert by_id[2]["title"] == "(untitled)"
    assert by_id[1]["owner_username"] == "ann" and by_id[4]["owner_username"] is None
    assert by_id[1]["correspondent_name"] == "ACME" and by_id[4]["correspondent_name"] is None
    assert by_id[1]["note"] == "note one" and by_id[2]["note"] == "note two"
    assert by_id[4]["source_url"] == "http://localhost:8000/documents/4"


def test_notes_by_foreign_key(tables):
    rows = documents.documents_view(tables, note_join="fk").collect()
    assert sorted((r["id"], r["note"]) for r in rows if r["note"]) == [(1, "note seven"), (2, "note one"), (2, "note two")]
    first = documents.documents_view(tables, note_join="fk_first")
    assert values(first.filter("note IS NOT NULL"), "id", "note") == [(1, "note seven"), (2, "note one")]
    with pytest.raises(ValueError):
        documents.documents_view(tables, note_join="other")


def test_soft_deleted(tables):
    assert values(documents.documents_view(tables, exclude_soft_deleted=True), "id") == [(1,), (2,), (5,)]


def test_only_ids(spark, tables):
    ids = spark.createDataFrame([(1,), (3,), (4,)], "id long")
    assert values(documents.documents_view(tables, only_ids=ids), "id", "tags") == sorted(
        [(1, ["a", "b", "b"]), (4, ["c"])], key=repr
    )


def test_large_dimensions_give_the_same(tables, monkeypatch):
    expected = values(documents.documents_view(tables))
    monkeypatch.setattr(sizing, "fits_broadcast", lambda *a, **k: False)
    assert values(documents.documents_view(tables)) == expected


def test_find_document(tables):
    assert [r["id"] for r in documents.find_document(tables, 2).collect()] == [2]
    assert documents.find_document(tables, 3).collect() == []  # not a PDF
    assert documents.find_document(tables, 12345).collect() == []


def test_lookup(spark, tables):
    asked = ["2", "3", "99999999", "not-a-number", " 2 ", "1.5", "", "2147483648", "2", "+4", None]
    requests = spark.createDataFrame(list(enumerate(asked)), "request_id int, id_text string")
    answers = {r["request_id"]: r for r in documents.lookup_documents(requests, tables).collect()}
    statuses = [answers[i]["status"] for i in range(len(asked))]
    assert statuses == ["OK", "NOT_FOUND", "NOT_FOUND"] + ["BAD_REQUEST"] * 5 + ["OK", "OK", "BAD_REQUEST"]
    assert answers[0]["title"] == "(untitled)" and answers[9]["title"] == "Four"


def test_hot_tag_rows_are_counted_before_they_are_collected(spark, tables):
    bridge = spark.range(3000).select(F.lit(1).cast("long").alias("document_id"), (20 + F.col("id") % 2).alias("tag_id"))
    tagged = documents.tags_per_document(bridge, tables.tags)
    assert tagged.first()["tags"] == ["a"] * 1500 + ["b"] * 1500
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert plan.index("collect_list") < plan.index("partial_count")


def test_path_join(tables):
    joined = join_path(tables, "documents", "document_tags", "tag")
    assert values(joined.filter("documents_id = 4"), "documents_id", "tag_name") == sorted([(4, None), (4, "c")], key=repr)
    assert join_path(tables, "notes", "document", "owner").filter("notes_id = 7").first()["owner_username"] == "ann"
    with pytest.raises(ValueError):
        join_path(tables, "documents", "elsewhere")


def test_condition_list(tables):
    none = tables.documents.filter(documents.all_of([]))
    assert none.count() == 5
    late = documents.documents_view(tables, [F.col("modified") >= F.lit(at(3)), F.col("owner_id") == 100])
    assert values(late, "id") == [(1,)]
