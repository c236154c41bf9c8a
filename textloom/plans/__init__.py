"""Queries over the standard tables, each with the SQL that gives the same rows where SQL can."""

from textloom.plans import conversations, extras, files, generated, metrics, overlaps, rows, sources, streams  # noqa: F401
from textloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
