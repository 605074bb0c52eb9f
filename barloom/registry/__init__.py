"""Registered queries over the given tables, with DuckDB oracles."""

from barloom.registry import features_q, jobs_q, labels_q, ops_q, trades_q  # noqa: F401
from barloom.registry.core import ORACLES, QUERIES  # noqa: F401
