"""Normalisation of free categorical columns to a closed vocabulary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .sets import in_list


def normalize_enum(
    column: str, allowed: Sequence[str], other: str = fv.OTHER_CATEGORY
) -> Column:
    """Upper-cased value of ``column`` when it belongs to ``allowed``, else ``other``.

    NULL gives ``other``.  Blanks and separators are left alone on purpose:
    ``"SELF PAY"`` is not ``"SELF_PAY"``.
    """
    return F.when(in_list(column, allowed, "upper"), F.upper(column)).otherwise(other)


def normalize_categories(
    df: DataFrame, vocabularies: Mapping[str, Sequence[str]] = fv.VOCABULARIES
) -> DataFrame:
    """Normalise every column named in ``vocabularies``; idempotent."""
    return df.withColumns(
        {name: normalize_enum(name, words) for name, words in vocabularies.items()}
    )
