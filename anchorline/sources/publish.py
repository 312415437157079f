"""Publishing a set of results as one: all of it is seen, or the set before.

``publish`` writes every table into a folder of this run, then a manifest (table, row
count, digest) beside it, and at last renames the manifest to its final name.  Readers
go by the newest manifest, so a run that fails leaves the earlier set as it was.

The digest is a sum over row hashes: it doesn't depend on the order of rows or files,
and it is observed while the rows are written.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "output string, rows bigint, digest string"


def _as_text(field: T.StructField) -> Column:
    """A value as text that other engines can build too: numbers in millionths, times in microseconds."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        text = F.round(column * 1_000_000).try_cast("bigint").cast("string")
        text = F.when(F.isnan(column), "NaN").otherwise(F.coalesce(text, column.cast("string")))
    elif isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
        text = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("\\N"))


def row_hash(schema: T.StructType) -> Column:
    """The first 60 bits of the md5 of a row's values, columns by name."""
    fields = sorted(schema.fields, key=lambda f: f.name)
    text = F.concat_ws("|", *[_as_text(f) for f in fields])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")


def digest_of(schema: T.StructType) -> Column:
    return F.coalesce(F.sum(row_hash(schema)).cast("string"), F.lit("0"))


@dataclass(frozen=True)
class Published:
    """One complete set: where its tables are, and what they hold."""

    spark: SparkSession
    folder: str
    manifest: DataFrame

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def damaged(self) -> list[str]:
        """Tables whose rows or digest are not those of the manifest."""
        wrong = []
        for name, rows, digest in self.manifest.collect():
            table = self.table(name)
            if tuple(table.agg(F.count(F.lit(1)), digest_of(table.schema)).first()) != (rows, digest):
                wrong.append(name)
        return wrong


def _file_system(spark: SparkSession, folder: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(context._jsc.hadoopConfiguration()), path


def publish(outputs: Mapping[str, DataFrame], folder: str) -> Published:
    """Write all tables, then make them the current set by one rename."""
    spark = next(iter(outputs.values())).sparkSession
    run = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid4().hex[:8]}"
    rows = []
    for name, frame in outputs.items():
        seen = Observation()
        counted = frame.observe(seen, F.count(F.lit(1)).alias("rows"), digest_of(frame.schema).alias("digest"))
        counted.write.parquet(f"{folder}/runs/{run}/{name}")
        rows.append((name, seen.get["rows"], seen.get["digest"]))
    ready = f"{folder}/pending/{run}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(ready)
    files, path = _file_system(spark, folder)
    files.mkdirs(path(f"{folder}/manifests"))
    if not files.rename(path(ready), path(f"{folder}/manifests/{run}")):
        raise OSError(f"{ready} could not be renamed")
    return current(spark, folder)


def current(spark: SparkSession, folder: str) -> Published:
    """The newest complete set."""
    files, path = _file_system(spark, folder)
    manifests = path(f"{folder}/manifests")
    found = sorted(s.getPath().getName() for s in files.listStatus(manifests)) if files.exists(manifests) else []
    if not found:
        raise FileNotFoundError(f"nothing is published in {folder}")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifests/{found[-1]}")
    return Published(spark, f"{folder}/runs/{found[-1]}", manifest)
