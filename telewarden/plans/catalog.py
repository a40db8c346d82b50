"""All registered queries."""

from __future__ import annotations

from telewarden.plans import detector_queries, ingest_queries, scoring_queries, table_queries  # noqa: F401
from telewarden.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
