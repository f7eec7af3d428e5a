"""All registered queries of the library, llm aside."""

from __future__ import annotations

from trailmark.plans import q_core, q_features, q_journeys, q_milestones, q_series, q_sources, q_survival, q_treatment
from trailmark.plans.registry import ORACLES, QUERIES

MODULES = (q_core, q_features, q_journeys, q_milestones, q_series, q_sources, q_survival, q_treatment)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
