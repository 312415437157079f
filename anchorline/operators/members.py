"""Membership of rows in a list of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import BROADCAST_ROWS, fits_broadcast, small_side


def members_of(
    df: DataFrame,
    members: DataFrame,
    key: str,
    max_members: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in ``members`` (repeats do not multiply rows).

    A list nobody counted, or a long one, is reduced to its distinct keys before
    the join: they are combined map-side, so a key that fills a third of the
    list is one row per task.  The combined keys are spread by another value than
    the join's, so that the join shuffles both of its sides itself and may split
    a key that fills a third of ``df``.
    """
    ids = members.select(key)
    if not fits_broadcast(max_members, broadcast_rows):
        ids = ids.withColumn("_spread", F.xxhash64(key)).distinct().drop("_spread")
    return df.join(small_side(ids, max_members, broadcast_rows), key, "left_semi")
