"""The queries of the library proper, each with its SQL twin."""

from __future__ import annotations

from .more import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
