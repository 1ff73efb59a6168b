"""Named queries over a directory of tables, and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("problems", "normalisation", "network", "scoring", "idioms", "intake", "measures", "learning", "reports", "worlds")


def collect() -> tuple[dict, dict]:
    """All registered queries and SQL texts of the core."""
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        module = import_module(f"peerlens.plans.{name}")
        queries.update(module.QUERIES)
        oracles.update(module.ORACLES)
    return queries, oracles
