"""Outcome probabilities for new subjects.

The contract is a subject list in and one probability per label out; the
models are the caller's: any ``pyspark.ml`` transformer per label.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROBABILITY_COLUMNS = {
    "mortality": "mortality_proba",
    "prolonged_los": "prolonged_LOS_proba",
    "readmission_30d": "readmission_proba",
}


def _positive_class(scored: DataFrame) -> Column:
    """``probability`` as a number: itself, or the second entry of a class vector."""
    column = F.col("probability")
    if isinstance(scored.schema["probability"].dataType, T.NumericType):
        return column.cast("double")
    return vector_to_array(column)[1]


def score_subjects(features: DataFrame, models: Mapping[str, Transformer]) -> DataFrame:
    """Apply one fitted model per label to the extracted cohort features.

    Each model reads cohort columns and writes ``probability``.  Pass models that
    were saved and loaded: a freshly fitted one may carry its training summary,
    and with it the session, into every task.
    """
    scored = features
    for label, name in PROBABILITY_COLUMNS.items():
        result = models[label].transform(scored)
        scored = result.select(*scored.columns, _positive_class(result).alias(name))
    return scored.select("subject_id", *PROBABILITY_COLUMNS.values())
