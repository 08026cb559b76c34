"""All registered queries of the library proper, with their SQL for the independent check."""

from __future__ import annotations

from veritrace.plans.base import ORACLE_SQL, QUERIES
from veritrace.plans import algorithms, analytics, dashboards, detectors, insight, registers, resolution, search, templates  # noqa: F401  each adds its queries

__all__ = ["ORACLE_SQL", "QUERIES"]
