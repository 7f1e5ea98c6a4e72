"""All queries of the core by name, with their SQL forms."""

from __future__ import annotations

from corvane.plans.oracle import ORACLE
from corvane.plans.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
