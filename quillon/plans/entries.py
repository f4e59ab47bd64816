"""All registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from quillon.plans import export_queries, long_queries, quality_queries, signal_queries, stream_queries, table_queries, track_queries  # noqa: F401
from quillon.plans.audit_queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
