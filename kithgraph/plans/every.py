"""All queries of the library."""

from kithgraph.plans import queries, queries_more  # noqa: F401
from kithgraph.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
