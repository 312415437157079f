"""When a join side may be broadcast.

A hint is given only for a side whose row count is bounded by a number somebody
has counted.  Everything else is left to Spark, which shuffles both sides and
splits hot keys at run time (AQE skew join).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PlanLimits:
    """Sizes that choose between plans; rows and results are the same on either side.

    ``broadcast_rows``: a counted side up to this many rows is broadcast.
    ``lookup_rows``: a bounds table up to this many rows becomes a literal IN.
    ``row_bytes``: what a narrow row (two ids, one timestamp) takes when hashed.
    ``hash_task_bytes``: a shuffled side is hashed, not sorted, if a task's part
    of it stays below this; a sort can spill, a hashed part cannot.
    """

    broadcast_rows: int = 500_000
    lookup_rows: int = 10_000
    row_bytes: int = 60
    hash_task_bytes: int = 32 << 20

    def fits_hash(self, max_rows: int | None, partitions: int) -> bool:
        return max_rows is not None and max_rows * self.row_bytes <= self.hash_task_bytes * partitions


DEFAULT_LIMITS = PlanLimits()
BROADCAST_ROWS = DEFAULT_LIMITS.broadcast_rows
LOOKUP_ROWS = DEFAULT_LIMITS.lookup_rows


def fits_broadcast(max_rows: int | None, limit: int = BROADCAST_ROWS) -> bool:
    """Is there a proven bound, and does it fit?"""
    return max_rows is not None and max_rows <= limit


def small_side(df: DataFrame, max_rows: int | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when its proven bound ``max_rows`` fits ``limit``."""
    return F.broadcast(df) if fits_broadcast(max_rows, limit) else df
