"""Registered queries over the given tables, each with its SQL counterpart."""

from catalog import cohort, files, profile, sampling, scoring  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
