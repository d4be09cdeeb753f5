"""All queries over the reference tables, and their oracle SQL."""

from __future__ import annotations

from lumora.plans import (  # noqa: F401  importing registers
    beyond,
    boxes,
    composites,
    intervals,
    library,
    measures,
    scalars,
    similarity,
    streams,
    voices,
)
from lumora.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
