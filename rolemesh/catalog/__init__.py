"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from .registry import ORACLES, QUERIES

from . import browsing, entities, enrichment, graphs, landing, state, textual, weaving  # noqa: E402,F401

__all__ = ["ORACLES", "QUERIES"]
