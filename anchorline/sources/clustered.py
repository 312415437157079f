"""Event tables stored so that a question about some items and days reads few files.

The rows of a table lie along a Z-curve over (item, time): each column is cut at its
own quantiles into ``2 ** bits`` steps, the bits of both steps are interleaved, and
the files are ranges of that key.  A file, and a row group in it, then holds a
narrow range of both columns, so that the minimum and maximum which every Parquet
reader looks at rule out most of them.  Visits, which are scattered over all files,
get a Parquet bloom filter.

Reading needs nothing special: any filter on item, time or visit is pushed to the
files.  Ranges are cut by key and visit, so an item with a third of all rows is
spread over as many files as it needs.  Only the quantiles come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SOURCE_SCHEMAS
from .tables import ClinicalTables

BITS = 5
#: Bytes of a row group; a small one can be skipped on its own.
ROW_GROUP_BYTES = 16 << 20
#: Event tables with items: the column of their time.
EVENT_TIMES = {
    "chartevents": "charttime",
    "labevents": "charttime",
    "inputevents_cv": "charttime",
    "inputevents_mv": "starttime",
    "procedureevents_mv": "starttime",
}


def as_number(df: DataFrame, name: str) -> Column:
    """A column's order as a number: a timestamp in seconds, anything else as a double."""
    if df.schema[name].dataType.typeName().startswith("timestamp"):
        return F.unix_timestamp(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def quantile_cuts(df: DataFrame, names: Sequence[str], bits: int = BITS) -> dict[str, list[float]]:
    """At most ``2 ** bits - 1`` distinct cut points of every column, by one pass."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(as_number(df, n), shares).alias(n) for n in names]).first()
    return {n: sorted(set(found[n] or ())) for n in names}


def step_of(value: Column, cuts: Sequence[float]) -> Column:
    """How many cuts lie below a value, by bisection; NULL comes first."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    above = F.lit(middle + 1) + step_of(value, cuts[middle + 1 :])
    return F.when(value > F.lit(cuts[middle]), above).otherwise(step_of(value, cuts[:middle]))


def interleaved(steps: Sequence[Column], bits: int = BITS) -> Column:
    """One number from the bits of several, the highest bits of all first."""
    taken = [
        F.shiftleft(F.shiftright(step, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(steps) + at)
        for bit in range(bits)
        for at, step in enumerate(steps)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), taken)


def write_clustered(
    events: DataFrame,
    path: str,
    by: Sequence[str],
    visit: str = "hadm_id",
    files: int | None = None,
    bits: int = BITS,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Write ``events`` along the Z-curve of the columns ``by``, in ``files`` ranges.

    Without ``files`` Spark's shuffle partitions decide.  All columns and rows are
    kept as they are; rows without a value in ``by`` lie at its beginning.
    Of each pair of bits that of the first column counts more, so its values lie in fewer runs.
    """
    cuts = quantile_cuts(events, by, bits)
    names = {c.lower() for c in events.columns}
    key = "_z"
    while key in names:
        key += "_"
    placed = events.withColumn(key, interleaved([step_of(as_number(events, n), cuts[n]) for n in reversed(by)], bits))
    order = [F.col(key), F.xxhash64(visit)]
    dealt = placed.repartitionByRange(*order) if files is None else placed.repartitionByRange(files, *order)
    (
        dealt.sortWithinPartitions(key, *by)
        .drop(key)
        .write.option("parquet.block.size", row_group_bytes)
        .option(f"parquet.bloom.filter.enabled#{visit}", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .mode("overwrite")
        .parquet(path)
    )


def store_clustered(spark: SparkSession, tables: ClinicalTables, root: str, files: int | None = None) -> ClinicalTables:
    """Write all ten tables below ``root``, those of ``EVENT_TIMES`` clustered, and open them."""
    for name in SOURCE_SCHEMAS:
        table, path = getattr(tables, name), f"{root}/{name}.parquet"
        if name in EVENT_TIMES:
            write_clustered(table, path, ["itemid", EVENT_TIMES[name]], files=files)
        else:
            table.write.mode("overwrite").parquet(path)
    return ClinicalTables.from_parquet(spark, root)
