"""Models that are kept in a folder: one stored ``pyspark.ml`` pipeline per label.

A scoring job loads what a training job saved.  Any fitted pipeline that writes
``probability`` will do; ``LogisticModel`` makes one from coefficients that were
estimated elsewhere, so that they can be stored and applied without a fit.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from .scoring import PROBABILITY_COLUMNS


@dataclass(frozen=True)
class LogisticModel:
    """A logistic regression with the value that stands in for each missing feature.

    A feature without a stand-in is 0 where it is NULL or NaN.
    """

    intercept: float
    coefficients: Mapping[str, float]
    fills: Mapping[str, float]

    def pipeline(self) -> PipelineModel:
        """Imputation, linear predictor and link as the stages of a pipeline."""
        known = [
            f"coalesce(nanvl(double(`{name}`), NULL), {self.fills.get(name, 0.0)!r}D) AS `filled_{name}`"
            for name in self.coefficients
        ]
        terms = [f"({value!r}D) * `filled_{name}`" for name, value in self.coefficients.items()]
        margin = " + ".join([f"({self.intercept!r}D)", *terms])
        statements = [
            f"SELECT *, {', '.join(known)} FROM __THIS__",
            f"SELECT *, {margin} AS margin FROM __THIS__",
            "SELECT *, 1D / (1D + exp(-margin)) AS probability FROM __THIS__",
        ]
        return PipelineModel([SQLTransformer(statement=s) for s in statements])


def save_models(models: Mapping[str, PipelineModel], folder: str) -> None:
    """Write one model per label below ``folder``, in place of earlier ones."""
    for label, model in models.items():
        model.write().overwrite().save(f"{folder}/{label}")


def load_models(folder: str) -> dict[str, PipelineModel]:
    """The models of all labels."""
    return {label: PipelineModel.load(f"{folder}/{label}") for label in PROBABILITY_COLUMNS}
