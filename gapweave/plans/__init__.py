"""Registered queries over the driver tables."""

from . import q_dynamics  # noqa: F401  (first: other modules reuse its checks)
from . import q_analyzers, q_ledger, q_observe, q_sources, q_streaming, q_tape_plan, q_thesis  # noqa: F401
from .registry import QUERIES, check_sql

__all__ = ["QUERIES", "check_sql"]
