"""All queries of the library, by name, and the SQL that states the same."""

from __future__ import annotations

from streamtable.plans import analytic_queries, core_queries, function_queries, io_queries, join_queries, stream_queries, window_queries  # noqa: F401  they register themselves
from streamtable.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
