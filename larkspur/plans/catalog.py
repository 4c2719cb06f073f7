"""All queries of the library, and their SQL."""

from larkspur.plans import detail_queries, index_queries, search_queries, store_queries, text_queries, tier_queries  # noqa: F401
from larkspur.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
