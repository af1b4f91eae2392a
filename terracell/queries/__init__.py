"""Registered queries: each applies an operator to the driver's tables and has a SQL twin where SQL can express it."""

from __future__ import annotations

from . import catalog, climate, files, geometry, grids, names, tables, temporal
from .base import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["catalog", "climate", "files", "geometry", "grids", "names", "oracle_sql", "queries", "tables", "temporal"]
