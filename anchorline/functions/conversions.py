"""Unit conversion chosen by item code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sets import in_list


def convert_units(value: str, item: str, factors: Mapping[float, Sequence[int]]) -> Column:
    """Multiply ``value`` by the factor whose item list holds ``item``.

    Items without a factor keep their value.
    """
    converted = F.col(value)
    for factor, items in factors.items():
        converted = F.when(in_list(item, items), F.col(value) * factor).otherwise(converted)
    return converted
