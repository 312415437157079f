"""Keys that should be unique: an audit, and one row for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """``key, copies`` of the keys that come more than once; counted before the shuffle."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def key_audit(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row: rows, missing keys, distinct keys, repeated keys and the rows beyond each key's first."""
    counts = df.groupBy(F.col(key).alias("audited")).agg(F.count(F.lit(1)).alias("copies"))
    known = F.col("audited").isNotNull()
    return counts.agg(
        F.lit(name).alias("relation"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(~known, F.col("copies"))), F.lit(0)).alias("missing"),
        F.count_if(known).alias("distinct_keys"),
        F.count_if(known & (F.col("copies") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(known, F.col("copies") - 1)), F.lit(0)).alias("surplus_rows"),
    )


def one_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's first row by ``order`` and then by all other columns; rows without a key stay.

    The rows of a key are reduced to one before the shuffle, so a key with a large
    share of all rows is harmless.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    ranked = [F.struct(F.col(c).isNull().alias("missing"), F.col(c).alias("value")).alias(c) for c in (*order, *rest)]  # NULLs last
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*ranked)).alias("first"))
    picked = first.select(*[F.col(key) if c == key else F.col(f"first.{c}.value").alias(c) for c in df.columns])
    return picked.unionAll(df.where(F.col(key).isNull()))
