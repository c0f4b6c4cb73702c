"""Registered queries: ``queries()`` on Spark, ``oracles()`` for DuckDB."""

from . import catalog_queries, evidence_queries, export_queries, feed_queries, scoring_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
