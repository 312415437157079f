"""Session settings of the job, the tests and the bench.

Nothing here changes results: all time arithmetic of the library is zone-less,
and every setting below only steers the physical plan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot visits are split by AQE in the shuffled event join
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # also where a split costs one more shuffle: joins that share a partitioning
    # with the step after them could not be split otherwise
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # item-code lists hold up to ~60 values; push them as a real IN so that
    # dictionaries and bloom filters can drop row groups, not only min/max
    "spark.sql.parquet.pushdown.inFilterThreshold": "128",
}
STATIC_SETTINGS = {
    # no call-site capture on every column expression: building a wide plan
    # takes a third of the driver calls
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def apply_plan_settings(spark: SparkSession) -> SparkSession:
    """Put the plan settings in force on a session that somebody else made."""
    for key, value in PLAN_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str | int = 8, name: str = "anchorline", **extra: str) -> SparkSession:
    """A local session for development; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in {**PLAN_SETTINGS, **STATIC_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
