"""All registered queries."""

from __future__ import annotations

from corpusloom.plans import calls, changes, queries, stored, texts
from corpusloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "calls", "changes", "queries", "stored", "texts"]
