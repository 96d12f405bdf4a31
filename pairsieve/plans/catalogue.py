"""Loads every module that registers queries."""

from pairsieve.plans import queries_features, queries_metrics, queries_models, queries_population, queries_review, queries_triage, queries_windows  # noqa: F401
from pairsieve.plans.registry import ENTRIES

__all__ = ["ENTRIES"]
