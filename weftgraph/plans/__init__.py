"""The declarative query algebra: JSON plans of seed, expand, combine, aggregate and project steps."""

from weftgraph.plans.engine import NO_LIMITS, Limits, PlanError, QueryEngine
from weftgraph.plans.planner import waves
from weftgraph.plans.validator import validate

__all__ = ["NO_LIMITS", "Limits", "PlanError", "QueryEngine", "validate", "waves"]
