"""Registered queries: every operator run on the given tables."""
from .registry import ORACLES, QUERIES
from . import access, categories, concat, merging, reshape, selection, sources, streams, updates, validation  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
