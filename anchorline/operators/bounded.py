"""Filtering of measurements to known items and plausible values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sets import in_list
from .sizing import LOOKUP_ROWS, small_side


def bounded(
    events: DataFrame,
    bounds: DataFrame,
    item: str,
    value: str,
    known_items: tuple[int, ...] | None = None,
) -> DataFrame:
    """Events whose item has bounds and whose value lies in ``[min, max]``.

    A missing bound, a missing value and NaN in either all fail.  An item listed twice
    yields the event once per matching row, as an inner join does.  With
    ``known_items`` the item test reaches the scan as a literal IN.
    """
    if known_items is not None:
        events = events.where(in_list(item, known_items))
    # NaN sorts above every number, so as an upper bound it would let all pass
    limits = bounds.select(
        F.col("itemid").alias(item),
        F.col("min").alias("_min"),
        F.nanvl("max", F.lit(None).cast("double")).alias("_max"),
    )
    limits = small_side(
        limits, len(known_items) if known_items is not None else None, LOOKUP_ROWS
    )
    return (
        events.join(limits, item)
        .where(F.col(value).between(F.col("_min"), F.col("_max")) & ~F.isnan(value))
        .select(*events.columns)
    )
