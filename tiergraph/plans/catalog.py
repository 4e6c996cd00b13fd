"""All driver-facing queries of the graph engine."""

from __future__ import annotations

from tiergraph.plans import ask_queries, build_queries  # noqa: F401
from tiergraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
