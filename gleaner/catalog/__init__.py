"""Registered queries: each pairs a Spark callable with the oracle SQL that checks it."""

from __future__ import annotations

from importlib import import_module

FAMILIES = [
    "ingest",
    "statements",
    "dedups",
    "findings",
    "files",
    "compare",
    "inventory",
    "web",
    "lines",
    "artifacts",
    "events",
    "sinks",
]


def all_queries() -> list:
    found = [q for family in FAMILIES for q in import_module(f"gleaner.catalog.{family}").QUERIES]
    names = [q.name for q in found]
    if len(names) != len(set(names)):
        raise ValueError("query names repeat")
    return found
