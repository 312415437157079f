"""Operators relative to one anchor instant per visit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import hours, true_or_zero
from .sizing import DEFAULT_LIMITS, PlanLimits, fits_broadcast


@dataclass(frozen=True)
class Anchor:
    """One row per visit with the instant that opens its window.

    ``max_rows`` is a proven upper bound of the number of visits (for example
    the counted length of the subject list), or ``None`` when nobody counted.
    ``span`` holds the first and last anchor instant when they were measured;
    then events outside all windows are not even read.
    """

    visits: DataFrame
    start: str = "admittime"
    max_rows: int | None = None
    limits: PlanLimits = DEFAULT_LIMITS
    span: tuple[datetime, datetime] | None = None

    @classmethod
    def counted(
        cls, visits: DataFrame, start: str = "admittime", limits: PlanLimits = DEFAULT_LIMITS
    ) -> "Anchor":
        """An anchor measured by one job now; worth it for a stored table."""
        rows, first, last = visits.agg(F.count(F.lit(1)), F.min(start), F.max(start)).first()
        span = None if first is None else (first, last)
        return cls(visits, start, rows, limits, span)


def within_anchor(
    events: DataFrame, anchor: Anchor, on: Sequence[str], time: str, window_hours: int
) -> DataFrame:
    """Events of anchored visits with ``start <= time <= start + window_hours``.

    Both ends are inclusive; an event without a time is dropped.  With a small
    counted anchor the events are never shuffled (broadcast hash join, window
    as residual).  With a larger one both sides are shuffled on the visit key,
    and if the anchor's part of a partition is small (``PlanLimits``) it is
    hashed, so that events need no sort; beyond that, and for an uncounted
    anchor, Spark chooses, and a sort-merge join can spill.  In all shuffled
    forms AQE may cut a hot visit's events into as many pieces as it needs.

    Before the shuffled join with a measured anchor, most events of other visits
    are dropped by ``of_known_keys`` on the last key of ``on``.
    """
    opened = anchor.visits.select(*on, F.col(anchor.start).alias("_start"))
    partitions = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if fits_broadcast(anchor.max_rows, anchor.limits.broadcast_rows):
        opened = F.broadcast(opened)
    elif anchor.limits.fits_hash(anchor.max_rows, partitions):
        opened = opened.hint("shuffle_hash")
    if anchor.span is not None:
        first, last = anchor.span
        until = last + timedelta(hours=window_hours)
        events = events.where(F.col(time).between(_instant(first), _instant(until)))
        if not fits_broadcast(anchor.max_rows, anchor.limits.broadcast_rows):
            events = of_known_keys(events, opened, on[-1], anchor.max_rows)
    return (
        events.join(opened, list(on))
        .where(F.col(time).between(F.col("_start"), F.col("_start") + hours(window_hours)))
        .drop("_start")
    )


# 8 MB of bits, whatever the number of keys
MOST_SLOTS = 1 << 26


def of_known_keys(df: DataFrame, known: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` without most rows whose ``key`` is not in ``known``; no row of a known key is lost.

    The keys of ``known`` (about ``rows``) are marked in a bit map of 16 slots per
    key, an array of words that a scalar subquery gives.  The test is a plain
    predicate, so it sinks to the scan and rows are dropped before any shuffle.
    About one of 17 unknown keys passes up to 4 million keys, more of them beyond,
    as the map stays within ``MOST_SLOTS``: an exact join has to follow.  Keys that
    are no integers are not tested.
    """
    if not all(isinstance(side.schema[key].dataType, T.IntegralType) for side in (df, known)):
        return df
    slots = min(MOST_SLOTS, 1 << max(16, (16 * rows - 1).bit_length()))
    # ids of another width are equal, so they must have equal hashes
    slot = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(slots))
    word, bit = F.shiftrightunsigned(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
    marks = known.select(word.alias("_word"), bit.alias("_bit")).selectExpr("_word", "shiftleft(1L, _bit) AS _bits")
    empty = df.sparkSession.range(slots >> 6).selectExpr("id AS _word", "0L AS _bits")
    words = marks.unionByName(empty).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    found = words.agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("_words")).select("_words._bits")
    return df.where(F.getbit(F.get(found.scalar(), word.cast("int")), bit) == 1)


def _instant(value: datetime) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


def attach(visits: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Left join of per-visit features; both sides hold at most one row per key."""
    return visits.join(features, key, "left").select(
        *visits.columns, *[c for c in features.columns if c != key]
    )


def exists_flag(visits: DataFrame, events: DataFrame, key: str, name: str) -> DataFrame:
    """0/1 column: does the visit have any row in ``events``?

    Distinct keys are combined map-side before they travel.
    """
    seen = events.select(key).distinct().withColumn(name, F.lit(True))
    flagged = attach(visits, seen, key)
    return flagged.withColumn(name, true_or_zero(F.col(name)))


def earliest_by(value: Column, order: Sequence[str], when: Column | None = None) -> Column:
    """Aggregate: the value of the row that comes first by ``order``.

    Rows outside ``when`` do not take part.  NaN, the other spelling of a
    missing number, is returned as NULL.
    """
    rank = F.struct(*order)
    first = F.min_by(value, rank if when is None else F.when(when, rank))
    return F.nanvl(first, F.lit(None).cast("double"))


def first_value(
    visits: DataFrame, events: DataFrame, key: str, value: str, order: Sequence[str]
) -> DataFrame:
    """Add the ``value`` of each visit's first event by ``order``; NULL without events.

    ``min_by`` keeps one candidate per visit and map task, so a visit with many
    events is reduced before the shuffle.
    """
    firsts = events.groupBy(key).agg(earliest_by(F.col(value), order).alias(value))
    return attach(visits, firsts, key)
