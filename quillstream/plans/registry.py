"""Every registered query of the engine with its SQL, by name."""

from __future__ import annotations

from . import activity, documents, live, nested, normalized, quizzes, stores, uploads  # noqa: F401  (they register their queries)
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
