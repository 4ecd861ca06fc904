"""Registered queries and their oracle SQL."""

from __future__ import annotations

from . import evidence, mart, review, texts, tools
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "evidence", "mart", "review", "texts", "tools"]
