"""Named inclusion criteria: masks, kept rows, complement and attrition counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK_PREFIX = "ok_"


def criteria_masks(df: DataFrame, criteria: Mapping[str, Column]) -> DataFrame:
    """Add one two-valued ``ok_<name>`` column per criterion; unknown counts as failed."""
    return df.withColumns(
        {f"{MASK_PREFIX}{name}": F.coalesce(rule, F.lit(False)) for name, rule in criteria.items()}
    )


def _passes_all(names: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"{MASK_PREFIX}{name}") for name in names])


def _without_masks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[f"{MASK_PREFIX}{name}" for name in names])


def kept_rows(df: DataFrame, criteria: Mapping[str, Column]) -> DataFrame:
    """Rows that meet every criterion."""
    names = list(criteria)
    return _without_masks(criteria_masks(df, criteria).where(_passes_all(names)), names)


def excluded_rows(df: DataFrame, criteria: Mapping[str, Column]) -> DataFrame:
    """Rows that miss at least one criterion, with their masks."""
    return criteria_masks(df, criteria).where(~_passes_all(list(criteria)))


def attrition_report(df: DataFrame, criteria: Mapping[str, Column]) -> DataFrame:
    """Counts per step as rows ``(step, n)``, from one aggregate over ``df``.

    ``passed:<name>`` counts all rows meeting a criterion; ``excluded:<name>``
    counts the excluded rows that miss it, so exclusion reasons overlap.
    """
    names = list(criteria)
    keep = _passes_all(names)
    counts = {
        "candidates": F.count(F.lit(1)),
        **{f"passed:{n}": F.count_if(F.col(f"{MASK_PREFIX}{n}")) for n in names},
        "kept": F.count_if(keep),
        "excluded": F.count_if(~keep),
        **{f"excluded:{n}": F.count_if(~keep & ~F.col(f"{MASK_PREFIX}{n}")) for n in names},
    }
    totals = criteria_masks(df, criteria).agg(
        *[expr.alias(f"c{i}") for i, expr in enumerate(counts.values())]
    )
    steps = F.array(
        *[
            F.struct(F.lit(step).alias("step"), F.col(f"c{i}").alias("n"))
            for i, step in enumerate(counts)
        ]
    )
    return totals.select(F.inline(steps))
