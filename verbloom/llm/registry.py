"""Queries and SQL of this package."""

from __future__ import annotations

import importlib

_MODULES = ("cluster", "cooccur", "termfreq", "neighbours", "distinct", "topn", "tokens", "leaks", "quality")


def _collected(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"verbloom.llm.{m}"), what, {})
    return out


def queries() -> dict:
    return _collected("QUERIES")


def oracle_sql() -> dict:
    return _collected("SQL")
