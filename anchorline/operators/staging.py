"""Materialising an intermediate result where every executor can read it again."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Only a plain local session without the setting gets a folder of its own; on a
    cluster, ``local-cluster`` included, a machine-local folder would be lost with
    its machine.  A ``file:`` setting is taken at its word: it may be a mount that
    all machines share.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="anchorline-")


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Lost executors then cost a re-read, not a recomputation, and the planner
    knows the real size of the result.
    """
    path = f"{folder}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The length of a file or of all files of a folder."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever Spark's file systems find it."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
