"""Imports every query module so that their queries register."""

from factorframe.plans import factor_queries, ic_queries, monitor_queries, panel_queries, portfolio_queries, research_queries  # noqa: F401
from factorframe.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
