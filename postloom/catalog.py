"""The engine's own query catalogue: name -> callable, and name -> DuckDB SQL."""

from postloom.plans import queries_pages, queries_posts, queries_records, queries_runs, queries_search, queries_texts  # noqa: F401  register their queries
from postloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
