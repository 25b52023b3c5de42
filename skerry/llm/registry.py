"""The training-data queries by name."""

from __future__ import annotations

import importlib

MODULES = ["parsing", "neighbours", "nearcopies", "credentials", "splitting", "handwritten", "packing", "mixing", "stuffing"]


def _each(what: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"skerry.llm.{m}"), what)
    return found


def queries() -> dict:
    return _each("QUERIES")


def sql() -> dict[str, str]:
    return _each("SQL")
