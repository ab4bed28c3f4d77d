"""All registered queries."""

from tidemark.plans import (  # noqa: F401
    window_queries,
    keyed_queries,
    pattern_queries,
    join_queries,
    parse_queries,
    enrich_queries,
    alert_queries,
    dashboard_queries,
    search_queries,
    metric_queries,
)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
