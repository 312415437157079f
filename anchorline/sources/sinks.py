"""Writers for the result bundle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',  # quotes are doubled, as spreadsheets and data-frame readers expect
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",  # keeps microseconds
}


def write_outputs(
    outputs: Mapping[str, DataFrame], path: str, fmt: str = "parquet"
) -> dict[str, int]:
    """Write each frame to ``{path}/{name}`` (overwriting) and return its row count.

    Counts ride on the write job as observed metrics; nothing is read twice.
    """
    counts = {}
    for name, frame in outputs.items():
        seen = Observation()
        writer = frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        if fmt == "csv":
            writer = writer.options(**CSV_OPTIONS)
        writer.format(fmt).save(f"{path}/{name}")
        counts[name] = seen.get["rows"]
    return counts
