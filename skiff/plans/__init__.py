"""Registered queries (``QUERIES``: name -> (spark, sf_dir) -> DataFrame)
and their DuckDB oracle SQL (``ORACLE``: name -> SQL)."""

from __future__ import annotations

import importlib

_MODULES = ["market", "serving", "telemetry", "corpus", "experiments", "fleet", "profiles", "files", "streams"]

QUERIES: dict = {}
ORACLE: dict = {}

for _m in _MODULES:
    _mod = importlib.import_module(f"skiff.plans.{_m}")
    QUERIES.update(_mod.QUERIES)
    ORACLE.update(getattr(_mod, "ORACLE", {}))
