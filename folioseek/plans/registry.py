"""Registered queries: a name, a DataFrame job over a table folder, and where possible SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from folioseek.plans.views import with_views

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    job: Job
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Job], Job]:
    """Register a job; ``views`` names the derived tables its SQL refers to."""

    def register(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, job, None if sql is None else with_views(sql, *views.split()))
        return job

    return register
