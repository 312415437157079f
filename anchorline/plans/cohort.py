"""Cohort selection: first admission per subject, criteria, labels, attrition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..config import DEFAULT_PARAMS, ExtractionParams
from ..functions import days, elapsed_seconds, normalize_categories, true_or_zero, within_days
from ..operators import (
    attrition_report,
    excluded_rows,
    first_with_next,
    kept_rows,
    members_of,
)
from ..operators.sizing import fits_broadcast
from ..sources.schemas import BASE_COLUMNS, COHORT_COLUMNS, TARGET_COLUMNS

_PATIENT_COLUMNS = ["subject_id", "gender", "dob", "dod"]
_ADMISSION_COLUMNS = [c for c in BASE_COLUMNS if c not in _PATIENT_COLUMNS[1:]]


def base_admissions(
    admissions: DataFrame,
    patients: DataFrame,
    subjects: DataFrame | None = None,
    max_subjects: int | None = None,
) -> DataFrame:
    """All admissions of the given subjects with their patient columns.

    A subject with several patient rows repeats its admissions here; whatever is
    built on first admissions takes one of them (``one_patient``).
    """
    visits = admissions.select(*_ADMISSION_COLUMNS)
    if subjects is not None:
        visits = members_of(visits, subjects, "subject_id", max_subjects)
    return visits.join(patients.select(*_PATIENT_COLUMNS), "subject_id").select(*BASE_COLUMNS)


def with_derived(index: DataFrame) -> DataFrame:
    """Age in 365-day years, length of stay in hours, and hours until death."""
    admit = F.col("admittime")
    return index.withColumns(
        {
            "admission_age": elapsed_seconds(F.col("dob"), admit) / F.lit(fv.SECONDS_PER_YEAR),
            "los_hours": elapsed_seconds(admit, F.col("dischtime")) / F.lit(fv.SECONDS_PER_HOUR),
            "hours_to_death": elapsed_seconds(admit, F.col("dod")) / F.lit(fv.SECONDS_PER_HOUR),
        }
    )


def one_patient(patients: DataFrame) -> DataFrame:
    """One patient row per subject: the first by birth, death, gender, missing ones last."""
    return _first_patient(patients.select(*_PATIENT_COLUMNS), ["subject_id"])


def _first_patient(df: DataFrame, key: list[str]) -> DataFrame:
    order = [F.asc_nulls_last(name) for name in ("dob", "dod", "gender")]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_patient", rank).where("_patient = 1").drop("_patient")


def index_from_base(base: DataFrame) -> DataFrame:
    """First admission per subject of a base frame, with the next admission time."""
    single = _first_patient(base, ["subject_id", "hadm_id"])
    return with_derived(
        first_with_next(single, "subject_id", "admittime", ["hadm_id"], "next_admittime")
    )


def index_admissions(
    admissions: DataFrame,
    patients: DataFrame,
    subjects: DataFrame | None = None,
    max_subjects: int | None = None,
) -> DataFrame:
    """``index_from_base(base_admissions(...))`` planned for large tables.

    Admissions are cut to one row per subject *before* any join that shuffles,
    so a subject with very many admissions never meets a join.  A short counted
    subject list filters first (broadcast); a long one joins afterwards, against
    one row per subject.
    """
    visits = admissions.select(*_ADMISSION_COLUMNS)
    short = subjects is not None and fits_broadcast(max_subjects)
    if short:
        visits = members_of(visits, subjects, "subject_id", max_subjects)
    # a missing subject id joins no patient; drop it before it forms a group
    visits = visits.where(F.col("subject_id").isNotNull())
    index = first_with_next(visits, "subject_id", "admittime", ["hadm_id"], "next_admittime")
    if subjects is not None and not short:
        index = index.join(subjects.select("subject_id").distinct(), "subject_id")
    return with_derived(index.join(one_patient(patients), "subject_id"))


def criteria(params: ExtractionParams = DEFAULT_PARAMS) -> dict[str, Column]:
    """The four inclusion criteria over an index frame."""
    return {
        "age": F.col("admission_age").between(params.min_age, params.max_age),
        "length_of_stay": F.col("los_hours") >= params.min_los_hours,
        "charted": F.col("has_chartevents_data") == 1,
        # an unknown time of death is not an early death
        "survived": F.coalesce(F.col("hours_to_death") >= params.min_los_hours, F.lit(True)),
    }


def select_cohort(index: DataFrame, params: ExtractionParams = DEFAULT_PARAMS) -> DataFrame:
    """Index rows that meet all criteria, with labels and normalised categories.

    Carries every column the cohort and the target tables are cut from.
    """
    kept = kept_rows(index, criteria(params))
    return normalize_categories(kept).withColumns(labels(params))


def labels(params: ExtractionParams = DEFAULT_PARAMS) -> dict[str, Column]:
    """The three 0/1 outcome labels over an index frame."""
    admitted, left = F.col("admittime"), F.col("dischtime")
    return {
        "mortality": within_days(F.col("dod"), left, params.mortality_days),
        "prolonged_los": true_or_zero(left - admitted > days(params.prolonged_los_days)),
        "readmission_30d": within_days(F.col("next_admittime"), left, params.readmission_days),
    }


def cohort_columns(selected: DataFrame) -> DataFrame:
    return selected.select(*COHORT_COLUMNS)


def target_columns(selected: DataFrame) -> DataFrame:
    return selected.select(*TARGET_COLUMNS)


def excluded(index: DataFrame, params: ExtractionParams = DEFAULT_PARAMS) -> DataFrame:
    """Index rows left out of the cohort, with one ``ok_*`` mask per criterion."""
    return excluded_rows(index, criteria(params))


def attrition(
    base: DataFrame,
    index: DataFrame,
    params: ExtractionParams = DEFAULT_PARAMS,
    subjects: DataFrame | None = None,
    patients: DataFrame | None = None,
) -> DataFrame:
    """How many rows each selection step leaves, as ``(step, n)``.

    ``listed`` (subject ids asked for), ``admissions`` (their admissions),
    ``repeated_patients`` (patient rows that are not the only or first of their
    subject), then the criteria over first admissions.
    """
    report = _row_count(base, "admissions").unionByName(attrition_report(index, criteria(params)))
    if patients is not None:
        per_subject = patients.where("subject_id IS NOT NULL").groupBy("subject_id").count()
        surplus = F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")
        repeated = per_subject.agg(surplus).select(F.lit("repeated_patients").alias("step"), "n")
        report = repeated.unionByName(report)
    return report if subjects is None else _row_count(subjects, "listed").unionByName(report)


def _row_count(df: DataFrame, step: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "n")
