"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

from boutlens.plans import assembled, career, evaluations, learned, matching, parsing, profiles, queries, ratings, reports, selections, walked
from boutlens.plans.registry import QUERIES, SQL

MODULES = [queries, career, matching, profiles, parsing, evaluations, selections, ratings, reports, learned, assembled, walked]

__all__ = ["MODULES", "QUERIES", "SQL"]
