"""All queries of the frame and evidence engine, with their SQL oracles."""

from framelight.plans import evidence_queries, frame_queries  # noqa: F401
from framelight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
