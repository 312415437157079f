"""Laboratory and vital-sign series of the window, restricted to plausible values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_PARAMS
from ..operators import Anchor, bounded, within_anchor
from ..sources.metadata import Bounds
from ..sources.schemas import MEASURE_COLUMNS
from .features import VISIT_KEYS

WINDOW = DEFAULT_PARAMS.window_hours


def plausible(events: DataFrame, bounds: Bounds) -> DataFrame:
    """Rows of listed items with a value inside the item's bounds."""
    rows = events.where(F.col("valuenum").isNotNull()).select(*MEASURE_COLUMNS)
    return bounded(rows, bounds.frame, "itemid", "valuenum", bounds.items)


def labs_in_window(
    labevents: DataFrame, anchor: Anchor, bounds: Bounds, window: int = WINDOW
) -> DataFrame:
    """Bounds are applied first: they need no shuffle and thin out what the join moves."""
    rows = within_anchor(plausible(labevents, bounds), anchor, VISIT_KEYS, "charttime", window)
    return rows.select(*MEASURE_COLUMNS)


def vitals_in_window(
    chartevents: DataFrame, anchor: Anchor, bounds: Bounds, window: int = WINDOW
) -> DataFrame:
    """As labs, for chart rows whose error mark is known to be 0."""
    return labs_in_window(chartevents.where(F.col("error") == 0), anchor, bounds, window)
