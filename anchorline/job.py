"""The extraction as a batch job: read, extract, write, report.

::

    python -m anchorline.job --tables /data/clinic --subjects ids.csv \\
        --lab-bounds labs.csv --vital-bounds vitals.csv --output /data/out
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .config import DEFAULT_PARAMS, ExtractionParams
from .plans import Extraction, extract
from .sources import ClinicalTables, load_bounds, load_subjects, write_outputs
from .session import apply_plan_settings
from .sources.schemas import MEASURE_COLUMNS
from .sources.sinks import CSV_OPTIONS

READERS = {
    "parquet": ClinicalTables.from_parquet,
    "csv": ClinicalTables.from_csv,
    "catalog": ClinicalTables.from_catalog,
}
SAMPLE_ROWS = 5


def first_rows(df: DataFrame) -> DataFrame:
    """The first rows of a result by its identifying columns."""
    order = [name for name in MEASURE_COLUMNS if name in df.columns]
    return df.orderBy(*order).limit(SAMPLE_ROWS)


@dataclass(frozen=True)
class JobReport:
    extraction: Extraction
    row_counts: dict[str, int]
    samples: dict[str, DataFrame]


def run_job(
    spark: SparkSession,
    tables: str,
    subjects: str,
    lab_bounds: str,
    vital_bounds: str,
    output: str,
    tables_format: str = "parquet",
    output_format: str = "csv",
    params: ExtractionParams = DEFAULT_PARAMS,
) -> JobReport:
    """Extract and write the four result tables.

    The session gets the plan settings.  Samples are the first rows of what was
    written, so nothing is computed twice.
    """
    apply_plan_settings(spark)
    extraction = extract(
        READERS[tables_format](spark, tables),
        load_subjects(spark, subjects),
        load_bounds(spark, lab_bounds),
        load_bounds(spark, vital_bounds),
        params,
    )
    outputs = extraction.outputs()
    counts = write_outputs(outputs, output, output_format)
    samples = {}
    for name, frame in outputs.items():
        reader = spark.read.schema(frame.schema).format(output_format)
        if output_format == "csv":
            reader = reader.options(**CSV_OPTIONS)
        samples[name] = first_rows(reader.load(f"{output}/{name}"))
    return JobReport(extraction, counts, samples)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="anchorline.job")
    for name in ("tables", "subjects", "lab-bounds", "vital-bounds", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--tables-format", choices=sorted(READERS), default="parquet")
    parser.add_argument("--output-format", choices=["csv", "parquet"], default="csv")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("anchorline").getOrCreate()
    report = run_job(spark, **vars(options))
    report.extraction.attrition.show(50, truncate=False)
    for name, count in report.row_counts.items():
        print(f"{name}: {count} rows in {options.output}/{name}")
        report.samples[name].show(truncate=False)


if __name__ == "__main__":
    main()
