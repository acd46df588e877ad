"""The registered queries of the core and their DuckDB counterparts."""

from __future__ import annotations

import importlib

_MODULES = ["scalars", "observed", "corpus", "checked", "extras"]


def _all(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"textkraal.plans.{m}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
