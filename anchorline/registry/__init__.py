"""Named queries over the test tables, and the SQL that checks them."""

from .oracle import oracle_sql
from .queries import queries

__all__ = ["oracle_sql", "queries"]
