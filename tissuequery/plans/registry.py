"""The reference queries by name, and their SQL."""

from __future__ import annotations

from .queries import QUERIES
from .sql import SQL

__all__ = ["QUERIES", "SQL"]
