"""Registered queries: every operator on the given tables, each next to its SQL."""

from batchloom.queries import (  # noqa: F401
    audit_queries,
    item_queries,
    pack_queries,
    redact_queries,
    run_queries,
    stream_queries,
)
from batchloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
