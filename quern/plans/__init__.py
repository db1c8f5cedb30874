"""Named queries over the star schema and their DuckDB twins."""

from __future__ import annotations

from . import audits, desk, flow, incremental, keep, memory, nights, people, records, remembering, retrieval, rules, series, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
