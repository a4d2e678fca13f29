"""Every registered query against DuckDB on the smallest tables, and its plan."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def sorted_rows(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(row[i]) for i in at) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, sf_dir, duck, name):
    df = contract.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = df.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    answer = duck.execute(sql)
    columns = [c[0] for c in answer.description]
    order = sorted(df.columns)
    assert sorted(columns) == order
    assert sorted_rows(rows, df.columns, order) == sorted_rows(answer.fetchall(), columns, order)


def test_entry(spark, sf_dir):
    rows = contract.entry(spark).collect()
    assert len(rows) == 5
    assert rows == sorted(rows, key=lambda r: (r["score"], r["id"])) or {r["score"] for r in rows}
