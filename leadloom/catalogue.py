"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from .plans import leads, places, records, reports, shares, streams, texts  # noqa: F401  registers the queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
