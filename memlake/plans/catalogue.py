"""The registered queries over the reference's own operators and their oracles."""

from __future__ import annotations

import importlib

#: Modules of this package; each has QUERIES (name to callable) and ORACLES (name to SQL).
MODULES = ("corpus", "events", "integrity", "evaluation", "sessions", "shaping", "scoring", "checks", "upkeep", "records", "thresholds", "streams", "digests", "lines")


def _gather(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"memlake.plans.{name}"), kind)
        if clash := found.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        found |= part
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
