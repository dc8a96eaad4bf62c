"""Queries over the driver's tables; importing this package registers them."""

from lodegraph.plans import events, graph, retrieval, text, tools  # noqa: F401
from lodegraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
