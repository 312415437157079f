"""Per-admission features from the first hours after admission.

Each feature exists twice: as an operator of its own (``add_*``), and as part
of ``add_all_features``, which reads every source once, joins all of it to the
anchor, and aggregates flags without a sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..config import DEFAULT_PARAMS
from ..functions import contains_any, convert_units, in_list, lowered, true_or_zero
from ..operators import Anchor, attach, exists_flag, first_value, within_anchor
from ..operators.anchored import earliest_by
from ..sources.tables import ClinicalTables

VISIT_KEYS = ["subject_id", "hadm_id"]
FIRST_READING_ORDER = ["event_time", "itemid", "valuenum"]
WINDOW = DEFAULT_PARAMS.window_hours

HEIGHT_ITEMS = fv.HEIGHT_INCH_ITEMS + fv.HEIGHT_CM_ITEMS
WEIGHT_ITEMS = fv.WEIGHT_KG_ITEMS + fv.WEIGHT_LB_ITEMS
VENT_ITEMS = fv.VENT_SETTING_ITEMS + fv.PEEP_ITEMS + fv.TIDAL_VOLUME_ITEMS
OXYGEN_ITEMS = [fv.OXYGEN_DEVICE_VENTILATOR_ITEM, fv.OXYGEN_DEVICE_NOT_OTHER_ITEM]
CHART_FEATURE_ITEMS = (
    HEIGHT_ITEMS + WEIGHT_ITEMS + VENT_ITEMS + OXYGEN_ITEMS + fv.RRT_CHART_ITEMS
)


# --- what counts as an event of a feature -----------------------------------


def error_free(chart: DataFrame, items: list[int]) -> DataFrame:
    """Chart rows of the given items whose error mark is known to be 0."""
    return chart.where(in_list("itemid", items) & (F.col("error") == 0))


def _at(df: DataFrame, time: str, *columns: str | Column) -> DataFrame:
    return df.select(*VISIT_KEYS, F.col(time).alias("event_time"), *columns)


def height_in_cm() -> Column:
    return convert_units("valuenum", "itemid", {fv.CM_PER_INCH: fv.HEIGHT_INCH_ITEMS})


def weight_in_kg() -> Column:
    return convert_units("valuenum", "itemid", {fv.KG_PER_LB: fv.WEIGHT_LB_ITEMS})


def shows_ventilation() -> Column:
    """A ventilator setting, or an oxygen device whose text says so.

    A missing text reads as empty, so it does not say "other" and counts.
    """
    item, text = F.col("itemid"), lowered("value")
    return (
        in_list("itemid", VENT_ITEMS)
        | ((item == fv.OXYGEN_DEVICE_VENTILATOR_ITEM) & text.contains(fv.VENTILATOR_TEXT))
        | ((item == fv.OXYGEN_DEVICE_NOT_OTHER_ITEM) & ~text.contains(fv.OTHER_DEVICE_TEXT))
    )


def height_readings(chart: DataFrame) -> DataFrame:
    rows = error_free(chart, HEIGHT_ITEMS).where(F.col("valuenum").isNotNull())
    return _at(rows, "charttime", "itemid", "valuenum", height_in_cm().alias("height_cm"))


def weight_readings(chart: DataFrame) -> DataFrame:
    rows = error_free(chart, WEIGHT_ITEMS).where(F.col("valuenum").isNotNull())
    return _at(rows, "charttime", "itemid", "valuenum", weight_in_kg().alias("weight_kg"))


def ventilation_events(chart: DataFrame) -> DataFrame:
    rows = error_free(chart, VENT_ITEMS + OXYGEN_ITEMS).where(shows_ventilation())
    return _at(rows, "charttime")


def input_events(cv: DataFrame, mv: DataFrame, items: list[int]) -> DataFrame:
    """Infusions of the given items from both charting systems, one time column."""
    listed = in_list("itemid", items)
    return _at(cv.where(listed), "charttime", "itemid").unionByName(
        _at(mv.where(listed), "starttime", "itemid")
    )


def antibiotic_orders(prescriptions: DataFrame) -> DataFrame:
    rows = prescriptions.where(contains_any("drug", fv.ANTIBIOTIC_KEYWORDS))
    return _at(rows, "startdate")


def rrt_events(procedures: DataFrame, chart: DataFrame) -> DataFrame:
    by_procedure = procedures.where(in_list("itemid", fv.RRT_PROCEDURE_ITEMS))
    return _at(by_procedure, "starttime").unionByName(
        _at(error_free(chart, fv.RRT_CHART_ITEMS), "charttime")
    )


def positive_cultures(micro: DataFrame) -> DataFrame:
    rows = micro.where(
        contains_any("spec_type_desc", [fv.BLOOD_CULTURE_TEXT])
        & F.col("org_name").isNotNull()
    )
    return _at(rows, "charttime")


# --- one operator per feature -----------------------------------------------


def _in_window(events: DataFrame, anchor: Anchor, window: int) -> DataFrame:
    return within_anchor(events, anchor, VISIT_KEYS, "event_time", window)


def _flag(cohort, events, anchor, name, window) -> DataFrame:
    return exists_flag(cohort, _in_window(events, anchor, window), "hadm_id", name)


def first_icu_times(icustays: DataFrame, anchor: Anchor, window: int = WINDOW) -> DataFrame:
    """Earliest ICU entry in the window; stays name the admission only."""
    stays = icustays.select("hadm_id", "intime")
    return (
        within_anchor(stays, anchor, ["hadm_id"], "intime", window)
        .groupBy("hadm_id")
        .agg(F.min("intime").alias("first_icu_intime"))
    )


def add_first_icu_intime(
    cohort: DataFrame, icustays: DataFrame, anchor: Anchor, window: int = WINDOW
) -> DataFrame:
    return attach(cohort, first_icu_times(icustays, anchor, window), "hadm_id")


def add_first_height(
    cohort: DataFrame, chart: DataFrame, anchor: Anchor, window: int = WINDOW
) -> DataFrame:
    readings = _in_window(height_readings(chart), anchor, window)
    return first_value(cohort, readings, "hadm_id", "height_cm", FIRST_READING_ORDER)


def add_first_weight(
    cohort: DataFrame, chart: DataFrame, anchor: Anchor, window: int = WINDOW
) -> DataFrame:
    readings = _in_window(weight_readings(chart), anchor, window)
    return first_value(cohort, readings, "hadm_id", "weight_kg", FIRST_READING_ORDER)


def add_received_vasopressor(
    cohort: DataFrame, cv: DataFrame, mv: DataFrame, anchor: Anchor, window: int = WINDOW
) -> DataFrame:
    events = input_events(cv, mv, fv.VASOPRESSOR_ITEMS)
    return _flag(cohort, events, anchor, "received_vasopressor", window)


def add_received_sedation(
    cohort: DataFrame, cv: DataFrame, mv: DataFrame, anchor: Anchor, window: int = WINDOW
) -> DataFrame:
    events = input_events(cv, mv, fv.SEDATION_ITEMS)
    return _flag(cohort, events, anchor, "received_sedation", window)


def add_received_antibiotic(
    cohort: DataFrame, prescriptions: DataFrame, anchor: Anchor, window: int = WINDOW
) -> DataFrame:
    events = antibiotic_orders(prescriptions)
    return _flag(cohort, events, anchor, "received_antibiotic", window)


def add_was_mechanically_ventilated(
    cohort: DataFrame, chart: DataFrame, anchor: Anchor, window: int = WINDOW
) -> DataFrame:
    events = ventilation_events(chart)
    return _flag(cohort, events, anchor, "was_mechanically_ventilated", window)


def add_received_rrt(
    cohort: DataFrame, procedures: DataFrame, chart: DataFrame, anchor: Anchor, window: int = WINDOW
) -> DataFrame:
    events = rrt_events(procedures, chart)
    return _flag(cohort, events, anchor, "received_rrt", window)


def add_positive_blood_culture(
    cohort: DataFrame, micro: DataFrame, anchor: Anchor, window: int = WINDOW
) -> DataFrame:
    events = positive_cultures(micro)
    return _flag(cohort, events, anchor, "positive_blood_culture", window)


# --- all features in one pass -----------------------------------------------

# What an event row stands for; one byte per row instead of one column each.
HEIGHT, WEIGHT, VASOPRESSOR, SEDATION, ANTIBIOTIC, VENTILATED, RRT, CULTURE = range(1, 9)
FLAG_SIGNALS = {
    "received_vasopressor": VASOPRESSOR,
    "received_sedation": SEDATION,
    "received_antibiotic": ANTIBIOTIC,
    "was_mechanically_ventilated": VENTILATED,
    "received_rrt": RRT,
    "positive_blood_culture": CULTURE,
}
# Flags that the chart decides, and those that it decides alone.
CHART_FLAGS = ["was_mechanically_ventilated", "received_rrt"]
CHART_ONLY_FLAGS = ["was_mechanically_ventilated"]


def _signal(code: int) -> Column:
    return F.lit(code).cast("tinyint")


def _signals(events: DataFrame, kind: Column, *, item=None, valuenum=None, reading=None):
    """Events in the common shape; the item code sets are disjoint, so one kind per row."""

    def or_null(column, kind_name):
        return F.lit(None).cast(kind_name) if column is None else column.cast(kind_name)

    return events.select(
        *VISIT_KEYS,
        "event_time",
        kind.alias("signal"),
        or_null(item, "bigint").alias("itemid"),
        or_null(valuenum, "double").alias("valuenum"),
        or_null(reading, "double").alias("reading"),
    ).where(F.col("signal").isNotNull())


def chart_signals(chart: DataFrame) -> DataFrame:
    """Heights, weights, ventilation and RRT rows from one read of the chart table."""
    measured = F.col("valuenum").isNotNull()
    kind = (
        F.when(in_list("itemid", HEIGHT_ITEMS) & measured, _signal(HEIGHT))
        .when(in_list("itemid", WEIGHT_ITEMS) & measured, _signal(WEIGHT))
        .when(in_list("itemid", fv.RRT_CHART_ITEMS), _signal(RRT))
        .when(shows_ventilation(), _signal(VENTILATED))
    )
    reading = convert_units(
        "valuenum",
        "itemid",
        {fv.CM_PER_INCH: fv.HEIGHT_INCH_ITEMS, fv.KG_PER_LB: fv.WEIGHT_LB_ITEMS},
    )
    rows = error_free(chart, CHART_FEATURE_ITEMS).withColumnRenamed("charttime", "event_time")
    return _signals(
        rows, kind, item=F.col("itemid"), valuenum=F.col("valuenum"), reading=reading
    )


def treatment_signals(tables: ClinicalTables) -> DataFrame:
    """Events of every source but the chart table."""
    infused = F.when(
        in_list("itemid", fv.VASOPRESSOR_ITEMS), _signal(VASOPRESSOR)
    ).otherwise(_signal(SEDATION))
    infusions = input_events(
        tables.inputevents_cv, tables.inputevents_mv, fv.VASOPRESSOR_ITEMS + fv.SEDATION_ITEMS
    )
    procedures = tables.procedureevents_mv.where(in_list("itemid", fv.RRT_PROCEDURE_ITEMS))
    parts = [
        _signals(infusions, infused),
        _signals(antibiotic_orders(tables.prescriptions), _signal(ANTIBIOTIC)),
        _signals(_at(procedures, "starttime"), _signal(RRT)),
        _signals(positive_cultures(tables.microbiologyevents), _signal(CULTURE)),
    ]
    return reduce(DataFrame.unionByName, parts)


def _flags(names: list[str]) -> list[Column]:
    return [F.max(F.col("signal") == FLAG_SIGNALS[name]).alias(name) for name in names]


def _readings() -> list[Column]:
    value, signal = F.col("reading"), F.col("signal")
    return [
        earliest_by(value, FIRST_READING_ORDER, signal == code).alias(name)
        for name, code in (("height_cm", HEIGHT), ("weight_kg", WEIGHT))
    ]


def feature_tables(
    tables: ClinicalTables,
    anchor: Anchor,
    window: int = WINDOW,
    charted: DataFrame | None = None,
) -> list[DataFrame]:
    """Readings and flags per admission, in tables that hold at most one row of each.

    Flags are hashed: no event of another source than the chart is ever sorted.
    The first readings need an order, so only chart rows meet it.  ``charted``
    may hold chart rows that are already cut to the window (see ``extract``);
    being stored, they are read twice, and only heights and weights are ordered.
    Otherwise the chart table is read here, once.  RRT comes from two sources and
    is a column of two tables.
    """
    treated = _in_window(treatment_signals(tables), anchor, window).groupBy("hadm_id")
    treatments = treated.agg(*_flags([n for n in FLAG_SIGNALS if n not in CHART_ONLY_FLAGS]))
    if charted is None:
        chart = _in_window(chart_signals(tables.chartevents), anchor, window)
        return [treatments, chart.groupBy("hadm_id").agg(*_readings(), *_flags(CHART_FLAGS))]
    chart = chart_signals(charted)
    measured = chart.where(F.col("signal").isin(HEIGHT, WEIGHT))
    return [
        treatments,
        measured.groupBy("hadm_id").agg(*_readings()),
        chart.groupBy("hadm_id").agg(*_flags(CHART_FLAGS)),
    ]


def add_all_features(
    cohort: DataFrame,
    tables: ClinicalTables,
    anchor: Anchor,
    window: int = WINDOW,
    charted: DataFrame | None = None,
) -> DataFrame:
    """The cohort with all nine derived columns."""
    with_icu = add_first_icu_intime(cohort, tables.icustays, anchor, window)
    by_procedure = "received_rrt"
    wide = with_icu
    for found in feature_tables(tables, anchor, window, charted):
        if by_procedure in wide.columns and by_procedure in found.columns:
            found = found.withColumnRenamed(by_procedure, "_by_chart")
        wide = attach(wide, found, "hadm_id")
    either = true_or_zero(F.coalesce(F.col(by_procedure), F.lit(False)) | F.col("_by_chart"))
    flags = {name: true_or_zero(F.col(name)) for name in FLAG_SIGNALS} | {by_procedure: either}
    return wide.select(
        *with_icu.columns, "height_cm", "weight_kg", *[flag.alias(name) for name, flag in flags.items()]
    )
