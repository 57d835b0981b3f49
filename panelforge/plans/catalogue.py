"""All queries of the core library with their SQL counterparts."""

from __future__ import annotations

from panelforge.plans import corpus_queries, source_queries, survey_queries, text_queries  # noqa: F401
from panelforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
