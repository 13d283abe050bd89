"""All queries of the engine by name, and the SQL that each is checked against."""

from __future__ import annotations

from quarry.plans import combinatorics, graphs, hybrid, lexical, sequences, sketches, storage, streams, text, vectors  # noqa: F401
from quarry.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
