"""Every operator bound to the driver's tables."""

from . import aggregates, alignments, joins, pipelines, scalars, sources, statistics, trees, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
