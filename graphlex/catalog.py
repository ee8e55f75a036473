"""All queries by name, with the SQL that a second engine checks them by."""

from .plans import graph_queries, model_queries, token_queries  # noqa: F401  registers the queries
from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "program_bits"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
