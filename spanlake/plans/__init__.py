"""Compositions of operators, and the registered queries with their check SQL."""

from __future__ import annotations

import importlib
import importlib.util

QUERY_MODULES = (
    "sources",
    "files",
    "cleaning",
    "passages",
    "terms",
    "identity",
    "retrieval",
    "labels",
    "metrics",
    "statistics",
    "answers",
    "spend",
    "facts",
)


def load_queries() -> None:
    for name in QUERY_MODULES:
        if importlib.util.find_spec(f"spanlake.plans.{name}_queries"):
            importlib.import_module(f"spanlake.plans.{name}_queries")
