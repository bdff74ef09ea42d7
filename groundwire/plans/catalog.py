"""All registered queries; importing the query modules fills the registry."""

from __future__ import annotations

from groundwire.plans import (  # noqa: F401
    citation_queries,
    knowledge_queries,
    operation_queries,
    policy_queries,
    routing_queries,
    stream_queries,
    turn_queries,
)
from groundwire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
