"""Importing this module registers every query."""

from ipvigil.catalog import aggregates, joins, models, partial_reports, scalars, streams  # noqa: F401
from ipvigil.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
