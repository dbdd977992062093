"""All named queries. Importing the family modules fills the registry."""

import importlib

from .registry import ORACLES, QUERIES

FAMILIES = ("core", "reduction", "policy", "ledger", "compare", "report", "triage", "planning", "flows", "streams")
for _family in FAMILIES:
    importlib.import_module(f"{__name__}.{_family}")

__all__ = ["QUERIES", "ORACLES"]
