"""Registered queries by area; each module has QUERIES and ORACLES."""

from __future__ import annotations

from importlib import import_module

AREAS = ("packed", "keys", "graph", "resolve", "compounds", "matching", "integration", "literature", "learning", "features", "overlays", "curation", "models")


def queries() -> dict:
    return {k: f for a in AREAS for k, f in import_module(f"{__name__}.{a}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for a in AREAS for k, s in getattr(import_module(f"{__name__}.{a}"), "ORACLES", {}).items()}
