"""The registered queries: one per operator, each with the SQL that gives the same result."""

from __future__ import annotations

import importlib

from tablegauge.workload.registry import ORACLE, QUERIES

MODULES = (
    "tables", "profiles", "checks", "repairs", "anomalies", "risks", "sql", "kpis", "features",
    "matching", "text", "evaluation", "charts", "streams",
)


def load() -> tuple[dict, dict]:
    """Import every workload module and return (queries, oracle SQL)."""
    for name in MODULES:
        importlib.import_module(f"tablegauge.workload.{name}")
    return QUERIES, ORACLE
