"""All registered queries with their SQL."""

from __future__ import annotations

from telemill.plans import rows, storage  # noqa: F401
from telemill.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
