"""Registered queries and their independent SQL."""

from __future__ import annotations

import importlib

from .oracle import CATALOG, Catalog

MODULES = [
    "advantages",
    "losses",
    "metrics",
    "batch",
    "prep",
    "score",
    "streams",
]


def load_catalog() -> Catalog:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return CATALOG
