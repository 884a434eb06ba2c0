"""All queries of the signal-map operators by name, and their SQL."""

from __future__ import annotations

from .plans import matching, results, signal, trackers, tracks  # noqa: F401  (modules register their queries)
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "flagship"
