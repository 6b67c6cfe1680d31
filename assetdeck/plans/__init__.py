"""Registered queries (one per asset operator) and their SQL oracles."""

from __future__ import annotations


def all_queries():
    """Import every query module once and return ``(QUERIES, ORACLES)``."""
    from . import q_admission, q_annotations, q_changes, q_checks, q_listing, q_scalars, q_sources, q_streaming, q_views  # noqa: F401
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
