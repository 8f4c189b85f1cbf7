"""Loads every catalog module, so that all queries are registered."""

from __future__ import annotations

from panelspark.plans import (  # noqa: F401
    queries_breaks, queries_clean, queries_describe, queries_evaluate, queries_features, queries_fitted, queries_ridge, queries_sarma, queries_sources,
    queries_stationarity, queries_textscan, queries_transforms, queries_var)
from panelspark.plans.catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
