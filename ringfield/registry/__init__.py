"""Queries over the given tables, each next to its SQL check."""

from ringfield.registry import curves, geometry, joins, raster, sources, workflows  # noqa: F401
from ringfield.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
