"""All named queries of the archive, by import of their modules."""

from __future__ import annotations

from . import archive, compared, lifecycle, outward, privacy, records, relations, search, stores, telemetry, timeline, vectors  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
