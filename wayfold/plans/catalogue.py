"""The queries over the reference tables, by name, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from . import check_queries, kernel_queries, line_queries, profile_queries, raster_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
