"""Inputs derived from the test tables, the registered queries and their SQL."""

from dossier.workload import export_queries, filter_queries, reply_queries, text_queries  # noqa: F401
from dossier.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
