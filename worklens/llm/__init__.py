"""Operators for training data, and their queries over the driver tables."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
