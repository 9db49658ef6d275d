"""Every query of the core."""

from __future__ import annotations

from . import evaluation, extracting, pairing, preparing, refining, streams  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
