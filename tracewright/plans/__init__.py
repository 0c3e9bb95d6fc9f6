"""Registered queries by operator id, each with SQL for another engine where SQL expresses it."""

from . import aggregates, boundaries, candidates, choices, divisions, graphs, joins, linking, readmission, scalars, scoring, streams, windows  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
