"""The registered queries: each operator applied to whole tables, beside equivalent SQL."""

from __future__ import annotations

from importlib import import_module

from strataspark.suite.registry import ORACLE, QUERIES

for _module in (
    "tables", "scalars", "joins", "aggregates", "ordering", "cohorts", "survival", "quality", "dashboards", "sampling", "studies",
):
    import_module(f"strataspark.suite.{_module}")

__all__ = ["ORACLE", "QUERIES"]
