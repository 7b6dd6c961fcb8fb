"""All registered queries."""

from forecourt.queries import listings, lookups, page_tables, scoring, texts  # noqa: F401
from forecourt.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
