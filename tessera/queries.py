"""Registered queries of the library and their DuckDB twins. Every module of ``tessera.plans.catalog`` adds its own."""

from __future__ import annotations

from .plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
