"""All registered queries of the market side."""

from __future__ import annotations

from tidemark.plans import context_queries, decision_queries, replay_queries, source_queries, state_queries, trade_queries  # noqa: F401  all register
from tidemark.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark, sf_dir: str):
    """The radar: trailing windows and book imbalance of every symbol, most active first."""
    return QUERIES["k3_radar"](spark, sf_dir)
