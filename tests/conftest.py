from __future__ import annotations

import sys
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folioseek.sources.schemas import SCHEMAS  # noqa: E402
from folioseek.sources.tables import Tables  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("folioseek-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).exists():
        pytest.skip("test tables are not here")
    return SF_DIR


def at(day: int, hour: int = 0) -> datetime:
    return datetime(2024, 1, day, hour)


ROWS = {
    "documents": [
        (1, "One", "first text", at(3), 10, "application/pdf", 100, date(2024, 1, 1), None),
        (2, None, "second text", at(2), None, "application/pdf", None, date(2024, 1, 2), None),
        (3, "Three", "third text", at(5), 11, "image/png", 101, date(2024, 1, 3), None),
        (4, "Four", "fourth text", at(3), 99, "application/pdf", 999, date(2024, 1, 4), at(9)),
        (5, "Five", "fifth text", None, 10, "application/pdf", 100, date(2024, 1, 5), None),
    ],
    "users": [(100, "ann"), (101, "bob")],
    "notes": [(1, "note one", 2), (2, "note two", 2), (7, "note seven", 1)],
    "correspondents": [(10, "ACME"), (11, "Zed")],
    "document_tags": [(1, 1, 20), (2, 1, 21), (3, 1, 20), (4, 2, 22), (5, 4, 23), (6, 4, 404)],
    "tags": [(20, "b"), (21, "a"), (22, None), (23, "c"), (24, "unused")],
    "sources": [
        (1, 1, "One", "ACME", date(2024, 1, 1), at(1), at(2), "DONE", None, at(1), at(2)),
        (2, 2, "Two", "", date(2024, 1, 2), at(2), at(4), "DONE", None, at(1), at(4)),
        (3, 4, "Four", "", date(2024, 1, 4), at(3), None, "RUNNING", None, at(1), at(3)),
        (4, 77, "Gone", "", date(2024, 1, 4), at(3), at(4), "DONE", None, at(1), at(1)),
    ],
    "chunks": [],
}


@pytest.fixture
def tables(spark) -> Tables:
    return Tables(**{name: spark.createDataFrame(ROWS[name], schema) for name, schema in SCHEMAS.items()})


def values(df, *columns):
    """Rows as sorted tuples."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(r) for r in rows), key=repr)
