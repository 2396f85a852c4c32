"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import analysis, bars, checks, joins, readers, risk, states, validation, windows  # noqa: F401  (they register themselves)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
