"""All queries of the engine proper and their SQL, by name."""

from __future__ import annotations

from .plans import more, programs, records, relational, scalars, searching, series, statistics, structures  # noqa: F401  (they register)
from .plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
