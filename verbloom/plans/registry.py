"""Queries and SQL of the core; the subpackage llm keeps its own."""

from __future__ import annotations

import importlib

_MODULES = ("hot_keys", "metrics", "association", "distributions", "features", "clustering", "serving", "streaming", "more", "structure", "presets", "files", "requests")


def _collected(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"verbloom.plans.{m}"), what, {})
    return out


def queries() -> dict:
    return _collected("QUERIES")


def oracle_sql() -> dict:
    return _collected("SQL")


def flagship(spark, sf_dir: str):
    """How good the label baseline is: purity and collocation by verb type and over all."""
    return queries()["purity_collocation"](spark, sf_dir)
