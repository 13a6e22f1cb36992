"""Queries over the driver tables, one per operator, and the SQL each must agree with."""

import importlib

from checks.registry import ORACLES, QUERIES

for _module in ("sessions", "masking", "lineage", "catalog", "events", "streams"):
    importlib.import_module(f"checks.{_module}")

__all__ = ["ORACLES", "QUERIES"]
