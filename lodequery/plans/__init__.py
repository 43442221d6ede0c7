"""Named queries over the tables, with the SQL that they are checked against."""
from lodequery.plans import search_queries, time_queries

QUERIES = search_queries.QUERIES | time_queries.QUERIES
ORACLE = search_queries.ORACLE | time_queries.ORACLE

__all__ = ["ORACLE", "QUERIES"]
