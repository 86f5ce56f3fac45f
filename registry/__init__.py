"""Queries over the driver tables, each with the equivalent SQL where SQL can say it."""

from registry import blocks, clean, files, learned, planning, sentiment, topics  # noqa: F401
from registry.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
