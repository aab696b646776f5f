"""All registered queries of the engine."""

from lectern.plans import aggregates, completion, jobs, lookups, matches, questions, relational, retrieval, scalars, scans, studies, supplement, surface, tidied  # noqa: F401
from lectern.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
