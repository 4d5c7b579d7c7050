"""Every registered query with its SQL twin."""

from __future__ import annotations

import importlib

MODULES = ("duplicates", "profiles", "samples", "models", "gates", "files")

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"catalog.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
