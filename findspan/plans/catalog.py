"""All registered queries."""

from findspan.plans import call_queries, file_queries, graph_queries, text_queries  # noqa: F401
from findspan.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
