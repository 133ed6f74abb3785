"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import base, buildings, corpus, files, graph, layouts, logs, retrieval  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
