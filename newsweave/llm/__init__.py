"""Operators of a training-data pipeline, one module each, and their queries."""

from newsweave.llm import queries  # noqa: F401
from newsweave.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
