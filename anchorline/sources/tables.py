"""The ten clinical source tables as one bundle of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SOURCE_SCHEMAS


SOURCE_ZONE = "UTC"


def wall_clock(instant: Column, zone: str = SOURCE_ZONE) -> Column:
    """What a clock in ``zone`` showed at a stored instant, whatever the session's zone."""
    since = F.make_dt_interval(secs=(F.unix_micros(instant) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + since
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def conform(df: DataFrame, schema: T.StructType, source_zone: str = SOURCE_ZONE) -> DataFrame:
    """The declared columns of ``df`` by name (any case, any order) and type.

    A column that already fits is passed through untouched, so that filters
    still reach the files.  Integer columns of another width fit: wide ids stay
    wide.  A stored instant becomes the wall-clock time of ``source_zone``.
    Anything else is cast.
    """
    stored = {name.lower(): kind for name, kind in ((f.name, f.dataType) for f in df.schema)}

    def column(field: T.StructField) -> Column:
        kind = stored.get(field.name)
        fits = kind == field.dataType or (
            isinstance(kind, T.IntegralType) and isinstance(field.dataType, T.IntegralType)
        )
        source = df[field.name]
        if not fits and isinstance(kind, T.TimestampType) and isinstance(field.dataType, T.TimestampNTZType):
            return wall_clock(source, source_zone).alias(field.name)
        return (source if fits else source.cast(field.dataType)).alias(field.name)

    return df.select(*[column(field) for field in schema.fields])


class ClinicalTables:
    """Gives each table as an attribute; a table is opened when first asked for."""

    def __init__(self, open_table: Callable[[str], DataFrame]):
        self._open_table = open_table
        self._opened: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SOURCE_SCHEMAS:
            raise AttributeError(name)
        if name not in self._opened:
            self._opened[name] = self._open_table(name)
        return self._opened[name]

    @classmethod
    def conformed(
        cls, open_table: Callable[[str], DataFrame], source_zone: str = SOURCE_ZONE
    ) -> "ClinicalTables":
        return cls(lambda name: conform(open_table(name), SOURCE_SCHEMAS[name], source_zone))

    @classmethod
    def from_parquet(
        cls, spark: SparkSession, root: str, source_zone: str = SOURCE_ZONE
    ) -> "ClinicalTables":
        """``{root}/{table}.parquet``, a file or a directory each."""
        return cls.conformed(lambda name: spark.read.parquet(f"{root}/{name}.parquet"), source_zone)

    @classmethod
    def from_csv(cls, spark: SparkSession, root: str) -> "ClinicalTables":
        """``{root}/{table}.csv`` with a header line."""
        return cls.conformed(
            lambda name: spark.read.option("header", True).csv(f"{root}/{name}.csv")
        )

    @classmethod
    def from_catalog(
        cls, spark: SparkSession, database: str, source_zone: str = SOURCE_ZONE
    ) -> "ClinicalTables":
        """Tables of a catalog database."""
        return cls.conformed(lambda name: spark.table(f"{database}.{name}"), source_zone)
