"""Registered queries, their table bindings and SQL twins."""

from . import q_coverage, q_folds, q_keys, q_lookup, q_metrics, q_more, q_rounds, q_samples, q_sources, q_spans, q_splits, q_text  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
