"""All checked queries, by importing the modules that register them."""

from demand_engine.plans import (  # noqa: F401
    ledger_queries,
    model_queries,
    planning_queries,
    rollup_queries,
    selection_queries,
    series_queries,
    source_queries,
    task_queries,
)
from demand_engine.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
