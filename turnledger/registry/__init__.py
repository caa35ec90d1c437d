"""Registered queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

PAIRS = (("usage", "usage_sql"), ("planning", "planning_sql"), ("transcripts", "transcripts_sql"), ("streams", "streams_sql"))


def all_queries() -> dict:
    out = {}
    for queries, _ in PAIRS:
        out.update(import_module(f"turnledger.registry.{queries}").QUERIES)
    return out


def all_sql() -> dict[str, str]:
    out = {}
    for _, sql in PAIRS:
        out.update(import_module(f"turnledger.registry.{sql}").SQL)
    return out
