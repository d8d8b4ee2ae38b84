"""Registered queries: every operator on the given tables, with the same answer in plain SQL."""

from catalog.base import REGISTRY, Entry

from catalog import scalars, profiles, groups, relations, maps, records, sheets, files  # noqa: E402,F401

__all__ = ["REGISTRY", "Entry"]
