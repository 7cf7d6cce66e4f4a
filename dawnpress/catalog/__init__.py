"""Registered queries: every operator on the driver's tables, with SQL to compare against."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every catalog module and return (queries, oracles)."""
    from dawnpress.catalog import base

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return base.QUERIES, base.ORACLES
