"""Queries over the sample tables, each with SQL that gives the same rows."""

from chronaudit.bindings import checks, primitives, sources  # noqa: F401  (fill the registry)
from chronaudit.bindings.registry import oracles, queries

__all__ = ["oracles", "queries"]
