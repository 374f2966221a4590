"""The core queries and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

from claimlens.registry import Query

FLAGSHIP = "l1_03_mention_f1"
MODULES = ("layer1", "layer2", "statistics", "relational", "agreement", "competence", "sampling", "texts", "generation", "detectors")


def _registries():
    return [import_module(f"claimlens.plans.{m}").registry for m in MODULES]


def queries() -> dict[str, Query]:
    return {name: q for r in _registries() for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for r in _registries() for name, q in r.sql.items()}
