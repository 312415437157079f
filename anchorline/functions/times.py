"""Zone-less time arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours(n: int) -> Column:
    """A constant interval of ``n`` hours."""
    return F.expr(f"INTERVAL '{int(n)}' HOUR")


def days(n: int) -> Column:
    """A constant interval of ``n`` days."""
    return F.expr(f"INTERVAL '{int(n)}' DAY")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """``end - start`` in seconds as a double, exact to the microsecond.

    The subtraction stays an interval until it is turned into a decimal, so the
    session time zone and its daylight-saving jumps never take part.
    """
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double")


def true_or_zero(condition: Column) -> Column:
    """A condition as a 0/1 integer, unknown counting as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def within_days(event: Column, anchor: Column, limit_days: int) -> Column:
    """0/1: the event is known and not later than ``anchor + limit_days`` (inclusive)."""
    return true_or_zero(event <= anchor + days(limit_days))
