"""Subject lists and per-item bounds."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import LOOKUP_ROWS

BOUNDS_SCHEMA = "itemid bigint, min double, max double"


def load_subjects(spark: SparkSession, path: str) -> DataFrame:
    """The ``subject_id`` column of a header CSV, duplicates kept."""
    return spark.read.option("header", True).csv(path).select(F.col("subject_id").cast("bigint"))


@dataclass(frozen=True)
class Bounds:
    """Plausible range per item.

    ``items`` holds the item ids when the table is known to be a small lookup
    (at most ``LOOKUP_ROWS`` rows); then they are pushed into the event scan as
    a literal IN and the table may be broadcast.  ``None`` means "not known to
    be small": it is joined without any hint.
    """

    frame: DataFrame
    items: tuple[int, ...] | None = None

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable[tuple[int, float, float]]) -> "Bounds":

        def number(value: float | None) -> float | None:
            return None if value is None else float(value)

        rows = [(int(item), number(low), number(high)) for item, low, high in rows]
        if not rows or len(rows) > LOOKUP_ROWS:
            return cls(spark.createDataFrame(rows, BOUNDS_SCHEMA), None if rows else ())
        # a literal relation: its size is known to the planner
        values = ", ".join(
            f"({item}L, DOUBLE('{low}'), DOUBLE('{high}'))" for item, low, high in rows
        ).replace("DOUBLE('None')", "CAST(NULL AS DOUBLE)")
        frame = spark.sql(f"SELECT * FROM VALUES {values} AS bounds(itemid, min, max)")
        return cls(frame, tuple(sorted({row[0] for row in rows})))

    @classmethod
    def measured(cls, frame: DataFrame) -> "Bounds":
        """Check the size of a bounds table with one count, then choose."""
        if frame.count() > LOOKUP_ROWS:
            return cls(frame)
        ids = frame.select("itemid").where(F.col("itemid").isNotNull()).distinct().collect()
        return cls(frame, tuple(sorted(row[0] for row in ids)))


def load_bounds(spark: SparkSession, path: str) -> Bounds:
    """``itemid, min, max`` of a header CSV, taken by name from any column set."""
    raw = spark.read.option("header", True).csv(path)
    return Bounds.measured(
        raw.select(
            F.col("itemid").cast("bigint"),
            F.col("min").cast("double"),
            F.col("max").cast("double"),
        )
    )
