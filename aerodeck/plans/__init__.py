"""Runnable plans; importing the package registers every query."""

from .registry import ORACLES, QUERIES
from . import scalar, relational, spatial, parsing, airport, served

__all__ = ["ORACLES", "QUERIES"]
