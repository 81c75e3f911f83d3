"""All queries of the engine's own operators."""

from __future__ import annotations

from .plans import matrices, more, records, spatial, stores, words  # noqa: F401  (they register their queries)
from .plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
