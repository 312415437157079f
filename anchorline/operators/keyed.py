"""First row and next value per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_with_next(
    df: DataFrame, key: str, order: str, ties: Sequence[str], next_name: str
) -> DataFrame:
    """The first row of each key, plus the ``order`` value of the row after it.

    Order is ``order`` ascending with NULLs last, then ``ties``.  Only the two
    leading rows of a key matter, so everything else is dropped by a per-task
    group limit before the shuffle: a key that holds a third of the table sends
    at most two rows per map task.
    """
    ranking = Window.partitionBy(key).orderBy(F.asc_nulls_last(order), *ties)
    leading = df.withColumn("_rank", F.row_number().over(ranking)).where("_rank <= 2")
    return (
        leading.withColumn(next_name, F.lead(order).over(ranking))
        .where("_rank = 1")
        .drop("_rank")
    )


def next_in_key(df: DataFrame, key: str, order: str, tie: str, next_name: str) -> DataFrame:
    """For every row the ``order`` value of the following row of its key.

    Rows follow each other by ``order`` (NULLs last), then ``tie``, which must
    be known and unique among rows of equal key and order.  ``order`` is a timestamp.

    A plain ``lead`` window would put a whole key into one task.  Instead rows
    are first reduced to the distinct instants of each key (combined map-side);
    instants are chained inside (key, day) groups, and the days of a key are
    chained through their first instants.  A row that is not the last of its
    instant is followed by the same instant; the last one by the next instant.
    No group is larger than the instants of one day or the days of one key.
    """
    instants = (
        df.where(F.col(order).isNotNull() & F.col(key).isNotNull())
        .groupBy(key, F.to_date(order).alias("_day"), order)
        .agg(F.max(tie).alias("_last_tie"))
    )
    in_day = Window.partitionBy(key, "_day").orderBy(order)
    over_days = Window.partitionBy(key).orderBy("_day")
    day_heads = (
        instants.groupBy(key, "_day")
        .agg(F.min(order).alias("_head"))
        .select(key, "_day", F.lead("_head").over(over_days).alias("_next_day_head"))
    )
    chained = (
        instants.withColumn("_next_instant", F.lead(order).over(in_day))
        .join(day_heads, [key, "_day"])
        .select(
            key,
            order,
            "_last_tie",
            F.coalesce("_next_instant", "_next_day_head").alias("_following"),
        )
    )
    return (
        df.join(chained, [key, order], "left")
        .withColumn(
            next_name,
            F.when(F.col(tie) < F.col("_last_tie"), F.col(order)).otherwise(F.col("_following")),
        )
        .select(*df.columns, next_name)
    )
