"""The query catalogue: importing the query modules fills the register."""

from __future__ import annotations

import importlib

from auditloom.plans.base import CATALOGUE, Query

MODULES = ["scan_queries", "pack_queries", "finding_queries", "rollup_queries", "routing_queries", "state_queries"]


def load() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"auditloom.plans.{name}")
    return CATALOGUE
