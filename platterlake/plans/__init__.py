"""Registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ("catalog", "relations", "scalars", "volumes")


def queries() -> dict:
    return {k: f for name in MODULES for k, f in importlib.import_module(f"{__name__}.{name}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for name in MODULES for k, q in importlib.import_module(f"{__name__}.{name}").ORACLE_SQL.items()}
