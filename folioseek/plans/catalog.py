"""Every registered query."""

from folioseek.plans import (  # noqa: F401
    catalog_documents,
    catalog_ingest,
    catalog_search,
    catalog_tables,
    catalog_vectors,
)
from folioseek.plans.registry import QUERIES

__all__ = ["QUERIES"]
