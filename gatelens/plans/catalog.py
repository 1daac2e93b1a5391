"""All registered queries: importing the modules registers them."""

from __future__ import annotations

from . import q_arrays, q_buckets, q_folds, q_intervals, q_islands, q_research, q_stats  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
