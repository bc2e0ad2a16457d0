"""The query catalogue: named plans over the tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import importlib

from parcelry.plans.registry import ORACLES, PLANS

for _name in ("dashboard", "records", "normalising", "validation", "extraction", "state"):
    importlib.import_module(f"parcelry.plans.{_name}")

__all__ = ["ORACLES", "PLANS"]
