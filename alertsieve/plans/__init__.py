"""Composed jobs and the registered queries with their SQL checks."""

from alertsieve.plans import model_queries, score_queries, series_queries, ticket_queries, triage_queries, vector_queries, job_queries  # noqa: F401, I001  the last one needs the SQL of the others
from alertsieve.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
