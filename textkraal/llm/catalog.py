"""The queries of the training-data operators."""

from __future__ import annotations

import importlib

_MODULES = ["p1_language", "p2_split_overlap", "p3_linked_splits", "p4_page_noise", "p5_token_budget", "p6_format_copies", "p7_leakage", "p8_mixing", "p9_subjects"]


def _all(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"textkraal.llm.{m}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
