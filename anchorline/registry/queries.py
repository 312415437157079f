"""One named query per operator, each over whole tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from uuid import uuid4

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import normalize_categories
from ..job import JobReport, first_rows, run_job
from ..operators import Anchor, PlanLimits, key_audit, members_of, next_in_key, shared_folder, staged, within_anchor
from ..plans import cohort as c
from ..plans import features as f
from ..plans.extraction import Extraction, extract
from ..plans.measures import labs_in_window, plausible, vitals_in_window
from ..plans.models import LogisticModel, load_models, save_models
from ..plans.scoring import score_subjects
from ..sources import Bounds, ClinicalTables, load_bounds, load_subjects, publish, write_clustered, write_outputs
from ..sources.quarantine import rejected_values
from ..sources.retail import clinical_tables, read_table, subject_list
from ..sources.schemas import MEASURE_COLUMNS, SOURCE_SCHEMAS
from ..sources.sinks import CSV_OPTIONS

Query = Callable[[SparkSession, str], DataFrame]

READING_COLUMNS = ["subject_id", "hadm_id", "event_time", "itemid", "valuenum"]


@dataclass(frozen=True)
class _Study:
    """The clinical views of one test folder and the frames the queries share."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def tables(self) -> ClinicalTables:
        return clinical_tables(self.spark, self.sf_dir)

    @cached_property
    def subjects(self) -> DataFrame:
        return subject_list(self.spark, self.sf_dir)

    @cached_property
    def listed(self) -> int:
        """Counted length of the subject list: the size check behind every broadcast."""
        return self.subjects.count()

    @cached_property
    def base(self) -> DataFrame:
        t = self.tables
        return c.base_admissions(t.admissions, t.patients, self.subjects, self.listed)

    @cached_property
    def index(self) -> DataFrame:
        t = self.tables
        return c.index_admissions(t.admissions, t.patients, self.subjects, self.listed)

    @cached_property
    def selected(self) -> DataFrame:
        return c.select_cohort(self.index)

    @cached_property
    def visits(self) -> DataFrame:
        return self.selected.select("subject_id", "hadm_id")

    @cached_property
    def anchor(self) -> Anchor:
        return Anchor(
            self.selected.select("subject_id", "hadm_id", "admittime"), max_rows=self.listed
        )

    @cached_property
    def lab_bounds(self) -> Bounds:
        return Bounds.from_rows(self.spark, fv.LAB_BOUNDS)

    @cached_property
    def vital_bounds(self) -> Bounds:
        return Bounds.from_rows(self.spark, fv.VITAL_BOUNDS)

    @cached_property
    def features(self) -> DataFrame:
        return f.add_all_features(c.cohort_columns(self.selected), self.tables, self.anchor)

    @cached_property
    def labs(self) -> DataFrame:
        return labs_in_window(self.tables.labevents, self.anchor, self.lab_bounds)

    @cached_property
    def vitals(self) -> DataFrame:
        return vitals_in_window(self.tables.chartevents, self.anchor, self.vital_bounds)

    @property
    def scratch(self) -> str:
        return f"{shared_folder(self.spark)}/anchorline/{uuid4().hex}"

    def extraction(self) -> Extraction:
        return extract(self.tables, self.subjects, self.lab_bounds, self.vital_bounds)

    @cached_property
    def stored(self) -> str:
        """All clinical tables written as text columns, to be read back with casts."""
        path = self.scratch
        # every event table is written from one join
        tables = clinical_tables(self.spark, self.sf_dir, f"{path}-views")
        for name in SOURCE_SCHEMAS:
            rows = getattr(tables, name)
            text = rows.select(*[F.col(c).cast("string").alias(c.upper()) for c in rows.columns])
            text.write.parquet(f"{path}/{name}.parquet")
        return path

    def job(self) -> JobReport:
        """The batch job over the stored tables."""
        path = self.scratch
        self.subjects.write.option("header", True).csv(f"{path}/subjects")
        for name, bounds in (("labs", self.lab_bounds), ("vitals", self.vital_bounds)):
            bounds.frame.write.option("header", True).csv(f"{path}/{name}")
        inputs = (f"{path}/{name}" for name in ("subjects", "labs", "vitals"))
        return run_job(self.spark, self.stored, *inputs, f"{path}/out")


# --- cohort -------------------------------------------------------------------


def subject_membership(s: _Study) -> DataFrame:
    listed = read_table(s.spark, s.sf_dir, "events").select(F.col("user_id").alias("subject_id"))
    # the id list is as long as the events table: no bound, no broadcast hint
    return members_of(s.tables.admissions, listed, "subject_id").select(
        "subject_id", "hadm_id", "admittime"
    )


def next_admission(s: _Study) -> DataFrame:
    visits = s.tables.admissions.select("subject_id", "hadm_id", "admittime")
    return next_in_key(visits, "subject_id", "admittime", "hadm_id", "next_admittime")


def derived_columns(s: _Study) -> DataFrame:
    early = F.coalesce(F.col("hours_to_death") < fv.MIN_LOS_HOURS, F.lit(False))
    return s.index.select(
        "subject_id",
        "hadm_id",
        "admission_age",
        "los_hours",
        early.alias("died_before_min_window"),
    )


def excluded(s: _Study) -> DataFrame:
    return c.excluded(s.index).select(
        "subject_id", "hadm_id", "ok_age", "ok_length_of_stay", "ok_charted", "ok_survived"
    )


def normalize_enums(s: _Study) -> DataFrame:
    return normalize_categories(
        s.tables.admissions.select("subject_id", "hadm_id", *fv.VOCABULARIES)
    )


def _label(name: str) -> Callable[[_Study], DataFrame]:
    return lambda s: s.selected.select("subject_id", "hadm_id", name)


# --- windows, features, measurements -------------------------------------------


def anchor_window(s: _Study) -> DataFrame:
    rows = s.tables.chartevents.select(*MEASURE_COLUMNS)
    return within_anchor(rows, s.anchor, f.VISIT_KEYS, "charttime", fv.WINDOW_HOURS).select(
        *MEASURE_COLUMNS
    )


def infusion_events(s: _Study) -> DataFrame:
    t = s.tables
    return f.input_events(
        t.inputevents_cv, t.inputevents_mv, fv.VASOPRESSOR_ITEMS + fv.SEDATION_ITEMS
    )


def labs_shuffled(s: _Study) -> DataFrame:
    """The labs of the window in the form that anchors above the broadcast limit take."""
    anchor = replace(s.anchor, limits=PlanLimits(broadcast_rows=0))
    return labs_in_window(s.tables.labevents, anchor, s.lab_bounds)


def labs_clustered(s: _Study) -> DataFrame:
    """The labs of the window, read from a table stored along its items and times."""
    path = s.scratch
    write_clustered(s.tables.labevents, path, ["itemid", "charttime"])
    return labs_in_window(s.spark.read.parquet(path), s.anchor, s.lab_bounds)


def vitals_clustered(s: _Study) -> DataFrame:
    """The vital signs of the window, read from a table stored along its items and times."""
    path = s.scratch
    write_clustered(s.tables.chartevents, path, ["itemid", "charttime"])
    return vitals_in_window(s.spark.read.parquet(path), s.anchor, s.vital_bounds)


# --- sources and sinks ----------------------------------------------------------


def subjects_from_csv(s: _Study) -> DataFrame:
    """Base admissions for a subject list that went through a CSV file."""
    path = s.scratch
    s.subjects.write.option("header", True).csv(path)
    listed = load_subjects(s.spark, path)
    return c.base_admissions(
        s.tables.admissions, s.tables.patients, listed, listed.count()
    ).select("subject_id", "hadm_id", "admittime")


def bounds_from_csv(s: _Study) -> DataFrame:
    """Labs of the window with bounds read from a CSV of seven columns."""
    path = s.scratch
    s.lab_bounds.frame.select(
        "itemid",
        F.lit("n/a").alias("measurement name"),
        F.lit("n/a").alias("feature name"),
        "min",
        "max",
        F.lit(None).cast("string").alias("units"),
        F.lit("n/a").alias("category"),
    ).write.option("header", True).csv(path)
    return labs_in_window(s.tables.labevents, s.anchor, load_bounds(s.spark, path))


def csv_roundtrip(s: _Study) -> DataFrame:
    """Targets written as CSV and read back with their schema."""
    path = s.scratch
    targets = c.target_columns(s.selected)
    write_outputs({"targets": targets}, path, "csv")
    return s.spark.read.schema(targets.schema).options(**CSV_OPTIONS).csv(f"{path}/targets")


def result_row_counts(s: _Study) -> DataFrame:
    """Rows per result table of the staged extraction."""
    counted = [
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("output"), "row_count"
        )
        for name, frame in s.extraction().outputs().items()
    ]
    first, *rest = counted
    for part in rest:
        first = first.unionByName(part)
    return first


def stored_tables(s: _Study) -> DataFrame:
    """Cohort and features from tables that were stored as text."""
    t = ClinicalTables.from_parquet(s.spark, s.stored)
    index = staged(c.index_admissions(t.admissions, t.patients, s.subjects, s.listed), s.scratch, "index")
    selected = c.select_cohort(index)
    anchor = Anchor.counted(selected.select(*f.VISIT_KEYS, "admittime"))
    wide = f.add_all_features(c.cohort_columns(selected), t, anchor)
    # ids were stored as text, so they come back as wide as the declared columns
    return wide.withColumns({key: F.col(key).cast("bigint") for key in f.VISIT_KEYS})


def job_row_counts(s: _Study) -> DataFrame:
    """The counts that the job observed while it wrote."""
    return s.spark.createDataFrame(list(s.job().row_counts.items()), "output string, row_count bigint")


def job_sample(name: str) -> Callable[[_Study], DataFrame]:
    def sample(s: _Study) -> DataFrame:
        rows = s.job().samples[name]
        return rows.withColumns({key: F.col(key).cast("bigint") for key in f.VISIT_KEYS})

    return sample


# --- scoring ---------------------------------------------------------------------

# Stand-in models: the engine ships none, so the contract is shown with fixed
# formulas.  Any fitted pyspark.ml model that writes `probability` fits in.
STAND_IN_PROBABILITIES = {
    "mortality": "admission_age / 200D + 0.25D * was_mechanically_ventilated",
    "prolonged_los": "0.25D * (received_vasopressor + received_sedation + received_rrt)",
    "readmission_30d": "0.125D + 0.5D * received_antibiotic",
}


# Intercept, coefficients and stand-ins for missing features, by label.
LOGISTIC_MODELS = {
    "mortality": (
        -3.25,
        {"admission_age": 0.03125, "weight_kg": -0.0078125, "received_vasopressor": 0.75, "was_mechanically_ventilated": 0.5},
        {"admission_age": 60.0, "weight_kg": 80.0},
    ),
    "prolonged_los": (
        -1.5,
        {"height_cm": 0.00390625, "received_sedation": 0.625, "received_rrt": 0.875},
        {"height_cm": 170.0},
    ),
    "readmission_30d": (-2.0, {"received_antibiotic": 0.375, "positive_blood_culture": 0.25}, {}),
}


def score_unseen(s: _Study) -> DataFrame:
    models = {
        label: SQLTransformer(statement=f"SELECT *, {formula} AS probability FROM __THIS__")
        for label, formula in STAND_IN_PROBABILITIES.items()
    }
    return score_subjects(s.features, models)


def score_saved_model(s: _Study) -> DataFrame:
    """Stored pipelines of logistic models, loaded and applied to the cohort."""
    folder = f"{s.scratch}/models"
    save_models({label: LogisticModel(*parts).pipeline() for label, parts in LOGISTIC_MODELS.items()}, folder)
    scored = score_subjects(s.features, load_models(folder))
    return scored.select("subject_id", *[F.round(c, 9).alias(c) for c in scored.columns[1:]])


def published_digests(s: _Study) -> DataFrame:
    """The manifest of the published extraction: row counts and digests, observed while it was written."""
    return publish(s.extraction().outputs(), s.scratch).manifest


def rejected_cells(s: _Study) -> DataFrame:
    """What a lenient read drops from admissions stored as text, some of whose cells are no values."""
    rows = s.tables.admissions
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    spoilt = text.withColumns(
        {
            "admittime": F.when(F.col("hadm_id") % 50 == 0, "unknown").otherwise(F.col("admittime")),
            "has_chartevents_data": F.when(F.col("subject_id") % 7 == 0, "yes").otherwise(F.col("has_chartevents_data")),
        }
    )
    return rejected_values(spoilt, SOURCE_SCHEMAS["admissions"], "admissions")


def admission_key_audit(s: _Study) -> DataFrame:
    """How unique the keys are on which tables are joined."""
    keys = {"admissions": "hadm_id", "patients": "subject_id", "icustays": "hadm_id", "labevents": "hadm_id"}
    audits = [key_audit(getattr(s.tables, name), key, name) for name, key in keys.items()]
    return reduce(DataFrame.unionAll, audits)


_QUERIES: dict[str, Callable[[_Study], DataFrame]] = {
    # cohort
    "base_admissions": lambda s: s.base,
    "subject_membership": subject_membership,
    "next_admission": next_admission,
    "first_admission": lambda s: s.index.select(
        "subject_id", "hadm_id", "admittime", "next_admittime"
    ),
    "derived_columns": derived_columns,
    "cohort": lambda s: c.cohort_columns(s.selected),
    "targets": lambda s: c.target_columns(s.selected),
    "cohort_from_base": lambda s: c.cohort_columns(c.select_cohort(c.index_from_base(s.base))),
    "label_mortality": _label("mortality"),
    "label_prolonged_los": _label("prolonged_los"),
    "label_readmission": _label("readmission_30d"),
    "attrition": lambda s: c.attrition(
        s.base, s.index, subjects=s.subjects, patients=s.tables.patients
    ),
    "excluded": excluded,
    "normalize_enums": normalize_enums,
    # window and single features
    "anchor_window": anchor_window,
    "first_icu_intime": lambda s: f.add_first_icu_intime(s.visits, s.tables.icustays, s.anchor),
    "first_height": lambda s: f.add_first_height(s.visits, s.tables.chartevents, s.anchor),
    "first_weight": lambda s: f.add_first_weight(s.visits, s.tables.chartevents, s.anchor),
    "flag_vasopressor": lambda s: f.add_received_vasopressor(
        s.visits, s.tables.inputevents_cv, s.tables.inputevents_mv, s.anchor
    ),
    "flag_sedation": lambda s: f.add_received_sedation(
        s.visits, s.tables.inputevents_cv, s.tables.inputevents_mv, s.anchor
    ),
    "flag_antibiotic": lambda s: f.add_received_antibiotic(
        s.visits, s.tables.prescriptions, s.anchor
    ),
    "flag_ventilated": lambda s: f.add_was_mechanically_ventilated(
        s.visits, s.tables.chartevents, s.anchor
    ),
    "flag_rrt": lambda s: f.add_received_rrt(
        s.visits, s.tables.procedureevents_mv, s.tables.chartevents, s.anchor
    ),
    "flag_blood_culture": lambda s: f.add_positive_blood_culture(
        s.visits, s.tables.microbiologyevents, s.anchor
    ),
    # event selection over whole event tables
    "height_readings": lambda s: f.height_readings(s.tables.chartevents),
    "weight_readings": lambda s: f.weight_readings(s.tables.chartevents),
    "ventilation_events": lambda s: f.ventilation_events(s.tables.chartevents),
    "infusion_events": infusion_events,
    "antibiotic_orders": lambda s: f.antibiotic_orders(s.tables.prescriptions),
    "rrt_events": lambda s: f.rrt_events(s.tables.procedureevents_mv, s.tables.chartevents),
    "positive_cultures": lambda s: f.positive_cultures(s.tables.microbiologyevents),
    "plausible_labs": lambda s: plausible(s.tables.labevents, s.lab_bounds),
    "plausible_vitals": lambda s: plausible(s.tables.chartevents, s.vital_bounds),
    # results
    "labs_48h": lambda s: s.labs,
    "vitals_48h": lambda s: s.vitals,
    "labs_48h_shuffled": labs_shuffled,
    "labs_48h_clustered": labs_clustered,
    "vitals_48h_clustered": vitals_clustered,
    "cohort_features": lambda s: s.features,
    "extract_cohort": lambda s: s.extraction().cohort,
    "extract_vitals": lambda s: s.extraction().vitals,
    "extract_labs": lambda s: s.extraction().labs,
    "extract_targets": lambda s: s.extraction().targets,
    "extract_attrition": lambda s: s.extraction().attrition,
    "result_row_counts": result_row_counts,
    "cohort_head": lambda s: first_rows(s.features),
    "targets_head": lambda s: first_rows(c.target_columns(s.selected)),
    "labs_head": lambda s: first_rows(s.labs),
    "vitals_head": lambda s: first_rows(s.vitals),
    # sources and sinks
    "subjects_from_csv": subjects_from_csv,
    "bounds_from_csv": bounds_from_csv,
    "csv_roundtrip": csv_roundtrip,
    "stored_tables": stored_tables,
    # batch job
    "job_row_counts": job_row_counts,
    "job_cohort_sample": job_sample("cohort"),
    "job_labs_sample": job_sample("labs"),
    # scoring contract
    "score_unseen": score_unseen,
    "score_saved_model": score_saved_model,
    # published results, keys
    "published_digests": published_digests,
    "admission_key_audit": admission_key_audit,
    "rejected_cells": rejected_cells,
}


def queries() -> dict[str, Query]:
    def bind(build: Callable[[_Study], DataFrame]) -> Query:
        return lambda spark, sf_dir: build(_Study(spark, sf_dir))

    return {name: bind(build) for name, build in _QUERIES.items()}
