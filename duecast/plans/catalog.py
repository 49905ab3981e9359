"""All queries and their SQL checks."""

from __future__ import annotations

import importlib

FAMILIES = ["history", "scalars", "filtering", "measures", "checks", "combining", "series", "modelling"]


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for family in FAMILIES:
        part = getattr(importlib.import_module(f"duecast.plans.{family}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"Query names used twice: {sorted(clash)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
