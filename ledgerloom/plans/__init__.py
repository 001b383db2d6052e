"""Queries by family; importing the families registers them."""

from ledgerloom.plans import capture, catalog, dedup, retention, status
from ledgerloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "capture", "catalog", "dedup", "retention", "status"]
