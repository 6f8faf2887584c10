"""All registered queries and their SQL."""

from __future__ import annotations

from rollcall.plans import cleaning_queries, coverage_queries, statistics_queries  # noqa: F401
from rollcall.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
