"""Cells that don't fit their declared type: kept out of the tables, and counted.

Tables stored as text are read with casts, and one bad cell ends a job.  Read leniently,
such a cell is NULL, and ``rejected_values`` says what was there and how often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import SOURCE_ZONE, conform


def _text_fields(df: DataFrame, schema: T.StructType) -> list[T.StructField]:
    """The declared columns that are stored as text and are of another type."""
    stored = {f.name.lower(): f.dataType for f in df.schema}
    return [
        f for f in schema.fields
        if isinstance(stored.get(f.name), T.StringType) and not isinstance(f.dataType, T.StringType)
    ]


def _bad(df: DataFrame, field: T.StructField) -> Column:
    return df[field.name].isNotNull() & df[field.name].try_cast(field.dataType).isNull()


def conform_leniently(df: DataFrame, schema: T.StructType, source_zone: str = SOURCE_ZONE) -> DataFrame:
    """As ``conform``, but a text that isn't a value of the declared type is NULL."""
    casts = {f.name: df[f.name].try_cast(f.dataType) for f in _text_fields(df, schema)}
    names = {c.lower(): c for c in df.columns}
    return conform(df.withColumns({names[name]: cast for name, cast in casts.items()}), schema, source_zone)


def rejected_values(df: DataFrame, schema: T.StructType, relation: str) -> DataFrame:
    """``relation, column_name, value, cells`` of the texts that a lenient read drops.

    One pass over the table; equal texts are counted before the shuffle.
    """
    fields = _text_fields(df, schema)
    cells = [F.when(_bad(df, f), F.struct(F.lit(f.name).alias("column_name"), df[f.name].alias("value"))) for f in fields]
    kind = "array<struct<column_name: string, value: string>>"
    bad = df.select(F.explode(F.array_compact(F.array(*cells).cast(kind))).alias("cell"))
    counted = bad.groupBy("cell.column_name", "cell.value").agg(F.count(F.lit(1)).alias("cells"))
    return counted.select(F.lit(relation).alias("relation"), "column_name", "value", "cells")


def conform_strictly(df: DataFrame, schema: T.StructType, relation: str, source_zone: str = SOURCE_ZONE) -> DataFrame:
    """As ``conform``, after a pass that refuses the table with its bad cells by column."""
    columns = rejected_values(df, schema, relation).groupBy("column_name").agg(F.sum("cells").alias("cells"))
    bad = sorted(tuple(r) for r in columns.collect())  # at most one row per declared column
    if bad:
        raise ValueError(f"{relation}: " + ", ".join(f"{n} bad cells in {name}" for name, n in bad))
    return conform(df, schema, source_zone)
