"""Registered queries over the driver's tables."""

from tablegov.plans import (  # noqa: F401
    q_conditions, q_functions, q_joins, q_metrics, q_mutate, q_streams, q_summaries, q_trees,
)
from tablegov.plans.q_conditions import page_orders
from tablegov.plans.registry import ORACLE, QUERIES
from tablegov.plans.views import Views

__all__ = ["ORACLE", "QUERIES", "Views", "page_orders"]
