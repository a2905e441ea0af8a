"""All queries of the race engine, by name."""

from . import aggregates, analysis, joins, kernels, merges, official, ranking, repairs, scans, similar, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
