"""Registered queries: each maps driver tables to one operator's result."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

MODULES = ["answers", "pools", "intervals", "phrases", "scoring", "building", "graph", "streams", "files"]


def load_all() -> ModuleType:
    """Import every catalog module and return the filled registry."""
    for name in MODULES:
        import_module(f"timeweave.catalog.{name}")
    return import_module("timeweave.catalog.registry")
