"""All registered queries."""

from __future__ import annotations

from gustara.plans import q_aggregates, q_functions, q_generate, q_models, q_relational, q_sources  # noqa: F401 - registration
from gustara.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
