"""The clinical plans: cohort, targets, features, measurements and the whole extraction."""

from .cohort import (
    attrition,
    base_admissions,
    cohort_columns,
    criteria,
    excluded,
    index_admissions,
    index_from_base,
    select_cohort,
    target_columns,
)
from .extraction import Extraction, extract
from .features import add_all_features
from .measures import labs_in_window, vitals_in_window
from .scoring import score_subjects

__all__ = [
    "Extraction",
    "add_all_features",
    "attrition",
    "base_admissions",
    "cohort_columns",
    "criteria",
    "excluded",
    "extract",
    "index_admissions",
    "index_from_base",
    "labs_in_window",
    "score_subjects",
    "select_cohort",
    "target_columns",
    "vitals_in_window",
]
