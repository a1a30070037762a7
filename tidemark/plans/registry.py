"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import analytics_queries, exposure_queries, panel_queries, scalar_queries

_MODULES = [exposure_queries, analytics_queries, panel_queries, scalar_queries]

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
