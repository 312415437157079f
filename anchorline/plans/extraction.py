"""The whole extraction: subjects in, cohort, targets, labs and vitals out."""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_PARAMS, ExtractionParams
from ..functions import in_list
from ..operators import (
    DEFAULT_LIMITS,
    Anchor,
    PlanLimits,
    members_of,
    remove_folder,
    shared_folder,
    staged,
    within_anchor,
)
from ..session import apply_plan_settings
from ..sources.metadata import Bounds
from ..sources.tables import ClinicalTables
from .cohort import (
    attrition,
    cohort_columns,
    index_admissions,
    select_cohort,
    target_columns,
)
from .features import CHART_FEATURE_ITEMS, VISIT_KEYS, add_all_features
from .measures import labs_in_window, plausible, vitals_in_window


@dataclass(frozen=True)
class Extraction:
    """The four result tables and the attrition report, all lazy."""

    cohort: DataFrame
    targets: DataFrame
    labs: DataFrame
    vitals: DataFrame
    attrition: DataFrame
    stage_folder: str | None = None

    def outputs(self) -> dict[str, DataFrame]:
        return {
            "cohort": self.cohort,
            "labs": self.labs,
            "vitals": self.vitals,
            "targets": self.targets,
        }

    def discard_stage(self) -> None:
        """Remove this run's intermediate results; its frames cannot be read any more."""
        if self.stage_folder is not None:
            remove_folder(self.cohort.sparkSession, self.stage_folder)


def extract(
    tables: ClinicalTables,
    subjects: DataFrame,
    lab_bounds: Bounds,
    vital_bounds: Bounds,
    params: ExtractionParams = DEFAULT_PARAMS,
    stage: bool = True,
    limits: PlanLimits = DEFAULT_LIMITS,
    settings: bool = True,
) -> Extraction:
    """Run the extraction for a list of subjects.

    The plan settings (``session.PLAN_SETTINGS``) are put in force on the session of
    ``subjects``, as its frames are run later; none changes results.  ``settings=False``
    leaves the session as it is.

    The length of the subject list is counted; it bounds the cohort and decides
    whether the anchor may be broadcast.

    With ``stage`` two intermediate results are written to the shared folder
    and read back: the index admissions (one row per subject, used by every
    output) and the chart rows of the window (so the chart table, the largest
    one, is read once for features and vitals together).  Without it the call
    is fully lazy and the chart table is read once per output that needs it.

    Both are staged whatever the bounds' size: a bounds table that is too long
    for a literal IN cuts the chart rows by a join instead.  The stage of a run
    is a folder of its own; ``discard_stage`` removes it.
    """
    if settings:
        apply_plan_settings(subjects.sparkSession)
    listed = subjects.count()
    index = index_admissions(tables.admissions, tables.patients, subjects, listed)
    folder = None
    if stage:
        folder = f"{shared_folder(subjects.sparkSession)}/anchorline/run-{uuid4().hex}"
        index = staged(index, folder, "index")
    selected = select_cohort(index, params)
    cohort = cohort_columns(selected)
    visits = selected.select(*VISIT_KEYS, "admittime")
    anchor = (
        Anchor.counted(visits, limits=limits) if stage else Anchor(visits, max_rows=listed, limits=limits)
    )

    charted = None
    if stage:
        charted = staged(
            chart_rows_in_window(tables.chartevents, anchor, vital_bounds, params.window_hours),
            folder,
            "chart",
        )
        vitals = plausible(charted, vital_bounds)
    else:
        vitals = vitals_in_window(tables.chartevents, anchor, vital_bounds, params.window_hours)

    # the report counts admissions, so their ids are all it needs
    listed_visits = members_of(tables.admissions.select("subject_id"), subjects, "subject_id", listed)
    base = listed_visits.join(tables.patients.select("subject_id"), "subject_id")
    return Extraction(
        cohort=add_all_features(cohort, tables, anchor, params.window_hours, charted),
        targets=target_columns(selected),
        labs=labs_in_window(tables.labevents, anchor, lab_bounds, params.window_hours),
        vitals=vitals,
        attrition=attrition(base, index, params, subjects, tables.patients),
        stage_folder=folder,
    )


def chart_rows_in_window(
    chartevents: DataFrame, anchor: Anchor, vital_bounds: Bounds, window: int
) -> DataFrame:
    """Error-free chart rows of the window that any feature or vital sign can use."""
    rows = chartevents.where(F.col("error") == 0).select(
        *VISIT_KEYS, "charttime", "itemid", "valuenum", "value", "error"
    )
    if vital_bounds.items is not None:
        rows = rows.where(in_list("itemid", sorted({*CHART_FEATURE_ITEMS, *vital_bounds.items})))
    else:
        ids = vital_bounds.frame.select("itemid")
        features = ids.sparkSession.createDataFrame([(i,) for i in CHART_FEATURE_ITEMS], "itemid bigint")
        rows = members_of(rows, ids.unionByName(features), "itemid")
    return within_anchor(rows, anchor, VISIT_KEYS, "charttime", window)
