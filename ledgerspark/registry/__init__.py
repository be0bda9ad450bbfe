"""Registered queries: one per capability, each over the provided tables."""

from ledgerspark.registry import controls, grids, logs, rollups, scalars  # noqa: F401
from ledgerspark.registry.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
