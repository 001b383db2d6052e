"""Intermediate tables of the operators."""

from ledgerloom.sources.shared import Scratch, shared_dir, written

__all__ = ["Scratch", "shared_dir", "written"]
