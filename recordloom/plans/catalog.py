"""All registered queries."""

from . import evidence, groups, measured, resources, search, summary, terms, typed  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
