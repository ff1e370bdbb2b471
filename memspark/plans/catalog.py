"""All queries of the library and their SQL."""

from memspark.plans import chat_queries, store_queries  # noqa: F401
from memspark.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
