"""Cohort selection and anchor-relative feature extraction on Spark."""

from .config import DEFAULT_PARAMS, ExtractionParams
from .plans import Extraction, extract
from .sources import Bounds, ClinicalTables, load_bounds, load_subjects, write_outputs

__all__ = [
    "Bounds",
    "ClinicalTables",
    "DEFAULT_PARAMS",
    "Extraction",
    "ExtractionParams",
    "extract",
    "load_bounds",
    "load_subjects",
    "write_outputs",
]
