"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from suite import analytics, builders, cleaning, forecasts, policies, sources, sql_surface, streams, tenants  # noqa: F401
from suite.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
