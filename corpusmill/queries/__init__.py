"""Registered queries over the bundled tables, each beside the SQL that must give the same rows."""

from corpusmill.queries import leakage, learning, metrics, relational, sampling, spans, text  # noqa: F401
from corpusmill.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
