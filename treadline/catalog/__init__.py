"""The registered queries, grouped like the operators they exercise."""
from __future__ import annotations

import importlib

GROUPS = ("scalar", "runs", "contacts", "cycles", "series", "tables")


def load():
    registry = importlib.import_module("treadline.catalog.registry")
    for group in GROUPS:
        importlib.import_module(f"treadline.catalog.{group}")
    return registry
