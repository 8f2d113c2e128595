"""Registered queries and their SQL equivalents, put together from the modules of this package."""

from __future__ import annotations

from tallow.plans import evaluation_queries, feature_queries, indicator_queries, model_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (indicator_queries, feature_queries, evaluation_queries, model_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES

FLAGSHIP = "candle_slice"
