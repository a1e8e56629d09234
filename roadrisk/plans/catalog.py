"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from roadrisk.plans import (  # noqa: F401
    context_queries,
    event_queries,
    feed_queries,
    model_queries,
    pricing_queries,
    stream_queries,
    trip_queries,
)
from roadrisk.plans.registry import QUERIES

__all__ = ["QUERIES"]
