"""Imports every module that registers queries."""

from __future__ import annotations

import importlib
import pkgutil

from slatewise import queries
from slatewise.queries.registry import QUERIES, Registered


def all_queries() -> dict[str, Registered]:
    for module in pkgutil.iter_modules(queries.__path__):
        importlib.import_module(f"{queries.__name__}.{module.name}")
    return QUERIES
