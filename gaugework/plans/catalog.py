"""Named queries over the test tables and their DuckDB twins.

Each module of ``gaugework.plans`` that ends in ``_queries`` holds one family:
``QUERIES`` maps a name to a callable ``(spark, sf_dir) -> DataFrame`` and
``ORACLES`` a name to SQL.
"""

from __future__ import annotations

from importlib import import_module

FAMILIES: list[str] = ["agreement_queries", "chart_queries", "sequential_queries", "decision_queries", "sensitivity_queries", "item_queries", "result_queries"]


def _gather(attr: str) -> dict:
    found: dict = {}
    for family in FAMILIES:
        found |= getattr(import_module(f"gaugework.plans.{family}"), attr)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
