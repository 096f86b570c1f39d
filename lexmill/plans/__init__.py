"""Registered queries, each beside the SQL that states the same result."""

from lexmill.plans import dictionaries, markup, more  # noqa: F401
from lexmill.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
