"""Registered queries: each Spark query next to the plain SQL that must give the same rows."""

from catalog.base import ORACLE, QUERIES  # noqa: F401
