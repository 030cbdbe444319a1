"""Registered queries and the SQL they are checked against."""

from marketops.plans import book_queries, gate_queries, research_queries  # noqa: F401  (registers its queries)
from marketops.plans.registry import QUERIES, Inputs

__all__ = ["QUERIES", "Inputs"]
