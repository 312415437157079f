"""Boundaries, NULLs and ties, one row each."""

from datetime import timedelta

import pytest

from anchorline import Bounds
from anchorline import fixed_values as fv
from anchorline.operators import Anchor, within_anchor
from anchorline.plans import cohort as c
from anchorline.plans import features as f
from anchorline.plans.measures import labs_in_window, vitals_in_window
from clinic import BASE, admission, d, event, frame, h, patient, subject_ids, tables

MICRO = timedelta(microseconds=1)


def index_of(spark, admissions, patients, ids=None, max_subjects=10):
    t = tables(spark, admissions=admissions, patients=patients)
    ids = subject_ids(spark, ids if ids is not None else {p["subject_id"] for p in patients})
    return c.index_admissions(t.admissions, t.patients, ids, max_subjects)


def kept(spark, adm, pat):
    return c.select_cohort(index_of(spark, [adm], [pat])).count() == 1


def visit_anchor(spark, subject=1, hadm=10, admit=BASE, max_rows=1):
    visits = frame(spark, "admissions", [admission(subject, hadm, admit)])
    return visits.select("subject_id", "hadm_id"), Anchor(visits, max_rows=max_rows)


def flag_of(df, name):
    (row,) = df.collect()
    return row[name]


# --- criteria -----------------------------------------------------------------


@pytest.mark.parametrize(
    "age_days,expected",
    [(18 * 365, True), (18 * 365 - 1, False), (89 * 365, True), (89 * 365 + 1, False)],
)
def test_age_uses_365_day_years_and_is_inclusive(spark, age_days, expected):
    assert kept(spark, admission(1, 10), patient(1, BASE - d(age_days))) is expected


def test_very_old_birth_date_does_not_overflow(spark):
    assert not kept(spark, admission(1, 10), patient(1, BASE - d(300 * 365)))


@pytest.mark.parametrize("stay,expected", [(h(54), True), (h(54) - MICRO, False)])
def test_minimum_stay(spark, stay, expected):
    assert kept(spark, admission(1, 10, stay=stay), patient(1)) is expected


@pytest.mark.parametrize("charted,expected", [(1, True), (0, False), (None, False)])
def test_charting(spark, charted, expected):
    assert kept(spark, admission(1, 10, has_chartevents_data=charted), patient(1)) is expected


@pytest.mark.parametrize(
    "after,expected", [(None, True), (h(53), False), (h(54), True), (-h(1), False)]
)
def test_early_death(spark, after, expected):
    died = None if after is None else BASE + after
    assert kept(spark, admission(1, 10), patient(1, died=died)) is expected


def test_missing_times_exclude(spark):
    assert not kept(spark, admission(1, 10, admit=None), patient(1))
    assert not kept(spark, admission(1, 10, dischtime=None), patient(1))
    assert not kept(spark, admission(1, 10), patient(1, born=None))


def test_null_admit_sorts_last_and_ties_go_to_the_lower_id(spark):
    rows = [
        admission(1, 11, None),
        admission(1, 12, BASE + d(2)),
        admission(1, 14, BASE),
        admission(1, 13, BASE),
    ]
    (row,) = index_of(spark, rows, [patient(1)]).collect()
    assert (row.hadm_id, row.next_admittime) == (13, BASE)


def test_first_admission_is_chosen_before_criteria(spark):
    rows = [admission(1, 11, BASE, stay=h(10)), admission(1, 12, BASE + d(10))]
    assert c.select_cohort(index_of(spark, rows, [patient(1)])).count() == 0


@pytest.mark.parametrize("max_subjects", [10, None])
def test_subjects_without_patient_or_off_the_list_are_left_out(spark, max_subjects):
    rows = [admission(s, s * 10) for s in (1, 2, 3)] + [admission(None, 99)]
    found = index_of(spark, rows, [patient(1), patient(2)], [1, 1, 3], max_subjects)
    assert [row.subject_id for row in found.collect()] == [1]


def test_excluded_is_the_complement(spark):
    rows = [admission(1, 10), admission(2, 20, has_chartevents_data=None), admission(3, 30, None)]
    index = index_of(spark, rows, [patient(1), patient(2), patient(3)])
    kept_ids = {r.hadm_id for r in c.select_cohort(index).collect()}
    out = {r.hadm_id: r for r in c.excluded(index).collect()}
    assert kept_ids == {10} and set(out) == {20, 30}
    assert (out[20].ok_charted, out[20].ok_age) == (False, True)
    assert (out[30].ok_age, out[30].ok_length_of_stay, out[30].ok_survived) == (False, False, True)


# --- labels -------------------------------------------------------------------


def labels(spark, admissions, pat):
    (row,) = c.target_columns(c.select_cohort(index_of(spark, admissions, [pat]))).collect()
    return tuple(row)[2:]


def test_stay_of_exactly_seven_days_is_not_prolonged(spark):
    assert labels(spark, [admission(1, 10, stay=d(7))], patient(1)) == (0, 0, 0)
    assert labels(spark, [admission(1, 10, stay=d(7) + MICRO)], patient(1)) == (0, 1, 0)


@pytest.mark.parametrize(
    "gap,expected", [(d(30), 1), (d(30) + MICRO, 0), (-d(2), 1)], ids=["edge", "late", "overlap"]
)
def test_readmission_window(spark, gap, expected):
    first = admission(1, 10)
    second = admission(1, 11, first["dischtime"] + gap)
    assert labels(spark, [first, second], patient(1))[2] == expected


@pytest.mark.parametrize("gap,expected", [(d(30), 1), (d(30) + MICRO, 0), (-d(1), 1)])
def test_mortality_window(spark, gap, expected):
    first = admission(1, 10)
    assert labels(spark, [first], patient(1, died=first["dischtime"] + gap))[0] == expected


# --- window -------------------------------------------------------------------


@pytest.mark.parametrize("max_rows", [1, None])
def test_window_is_inclusive_at_both_ends(spark, max_rows):
    _, anchor = visit_anchor(spark, max_rows=max_rows)
    times = [BASE, BASE + h(48), BASE - MICRO, BASE + h(48) + MICRO, None]
    rows = frame(spark, "chartevents", [event(1, 10, t, i) for i, t in enumerate(times)])
    found = within_anchor(rows, anchor, ["subject_id", "hadm_id"], "charttime", 48)
    assert sorted(r.itemid for r in found.collect()) == [0, 1]


def test_window_needs_both_keys(spark):
    _, anchor = visit_anchor(spark)
    rows = frame(
        spark, "chartevents", [event(2, 10, BASE, 1), event(1, 11, BASE, 2), event(None, 10, BASE, 3)]
    )
    assert within_anchor(rows, anchor, ["subject_id", "hadm_id"], "charttime", 48).count() == 0


def test_icu_entry_is_the_earliest_inside_the_window(spark):
    visits, anchor = visit_anchor(spark)
    stays = frame(
        spark,
        "icustays",
        [{"hadm_id": 10, "intime": BASE + t} for t in (-h(1), h(5), h(3), h(49))],
    )
    assert flag_of(f.add_first_icu_intime(visits, stays, anchor), "first_icu_intime") == BASE + h(3)


# --- first values -------------------------------------------------------------


def test_first_height_skips_bad_rows_and_breaks_ties(spark):
    visits, anchor = visit_anchor(spark)
    chart = frame(
        spark,
        "chartevents",
        [
            event(1, 10, BASE + h(1), 3485, 150.0, error=1),
            event(1, 10, BASE + h(1), 3485, 151.0, error=None),
            event(1, 10, BASE + h(1), 3485, None),
            event(1, 10, BASE + h(1), 762, 70.0),
            event(1, 10, BASE + h(2), 3485, 170.0),
            event(1, 10, BASE + h(2), 3485, 169.0),
            event(1, 10, BASE + h(3), 920, 60.0),
        ],
    )
    assert flag_of(f.add_first_height(visits, chart, anchor), "height_cm") == 169.0


def test_first_reading_that_is_not_a_number_is_missing(spark):
    visits, anchor = visit_anchor(spark)
    chart = frame(
        spark,
        "chartevents",
        [event(1, 10, BASE + h(1), 762, float("nan")), event(1, 10, BASE + h(2), 762, 70.0)],
    )
    assert flag_of(f.add_first_weight(visits, chart, anchor), "weight_kg") is None


# --- flags --------------------------------------------------------------------


@pytest.mark.parametrize(
    "item,text,error,expected",
    [
        (223849, None, 0, 1),
        (60, "x", 0, 1),
        (639, None, 0, 1),
        (223849, None, 1, 0),
        (223849, None, None, 0),
        (467, "On VENTILATOR", 0, 1),
        (467, None, 0, 0),
        (467, "Mask", 0, 0),
        (223848, None, 0, 1),
        (223848, "Other device", 0, 0),
        (223848, "Ventilator", 0, 1),
        (999, "Ventilator", 0, 0),
    ],
)
def test_ventilation_rule(spark, item, text, error, expected):
    visits, anchor = visit_anchor(spark)
    chart = frame(spark, "chartevents", [event(1, 10, BASE, item, None, text, error)])
    result = f.add_was_mechanically_ventilated(visits, chart, anchor)
    assert flag_of(result, "was_mechanically_ventilated") == expected


@pytest.mark.parametrize("source", ["cv", "mv", "none"])
def test_sedation_from_either_source(spark, source):
    visits, anchor = visit_anchor(spark)
    cv = frame(spark, "inputevents_cv", [event(1, 10, BASE, 30131)] * (source == "cv"))
    mv = frame(
        spark,
        "inputevents_mv",
        [event(1, 10, BASE, 30131, time="starttime")] * (source == "mv"),
    )
    result = f.add_received_sedation(visits, cv, mv, anchor)
    assert flag_of(result, "received_sedation") == int(source != "none")
    assert flag_of(f.add_received_vasopressor(visits, cv, mv, anchor), "received_vasopressor") == 0


@pytest.mark.parametrize(
    "drug,expected",
    [("ZOSYN 4.5g", 1), ("Piperacillin/Tazobactam", 1), ("Aspirin", 0), (None, 0), ("", 0)],
)
def test_antibiotic_keywords(spark, drug, expected):
    visits, anchor = visit_anchor(spark)
    rx = frame(
        spark,
        "prescriptions",
        [{"subject_id": 1, "hadm_id": 10, "startdate": BASE, "drug": drug}],
    )
    assert flag_of(f.add_received_antibiotic(visits, rx, anchor), "received_antibiotic") == expected


def test_rrt_from_chart_only(spark):
    visits, anchor = visit_anchor(spark)
    none = frame(spark, "procedureevents_mv", [])
    good = frame(spark, "chartevents", [event(1, 10, BASE, 152)])
    bad = frame(spark, "chartevents", [event(1, 10, BASE, 152, error=None)])
    assert flag_of(f.add_received_rrt(visits, none, good, anchor), "received_rrt") == 1
    assert flag_of(f.add_received_rrt(visits, none, bad, anchor), "received_rrt") == 0


@pytest.mark.parametrize(
    "specimen,organism,expected",
    [("BLOOD CULTURE (MYCO)", "STAPH", 1), ("Blood Culture", None, 0), ("URINE", "X", 0), (None, "X", 0)],
)
def test_blood_culture(spark, specimen, organism, expected):
    visits, anchor = visit_anchor(spark)
    micro = frame(
        spark,
        "microbiologyevents",
        [
            {
                "subject_id": 1,
                "hadm_id": 10,
                "spec_type_desc": specimen,
                "org_name": organism,
                "charttime": BASE,
            }
        ],
    )
    result = f.add_positive_blood_culture(visits, micro, anchor)
    assert flag_of(result, "positive_blood_culture") == expected


# --- bounds -------------------------------------------------------------------


@pytest.mark.parametrize("pushed", [True, False])
def test_bounds_are_inclusive_and_nan_fails(spark, pushed):
    _, anchor = visit_anchor(spark)
    values = [0.1, 15.0, 0.0999, 15.0001, None, float("nan"), float("inf")]
    rows = [event(1, 10, BASE, 50912, v) for v in values] + [event(1, 10, BASE, 999, 1.0)]
    bounds = Bounds.from_rows(spark, fv.LAB_BOUNDS)
    if not pushed:
        bounds = Bounds(bounds.frame)
    found = labs_in_window(frame(spark, "labevents", rows), anchor, bounds)
    assert sorted(r.valuenum for r in found.collect()) == [0.1, 15.0]


def test_missing_bound_drops_and_repeated_item_multiplies(spark):
    _, anchor = visit_anchor(spark)
    table = spark.createDataFrame(
        [(1, None, 5.0), (2, 0.0, 5.0), (2, 0.0, 9.0), (3, 0.0, float("nan"))],
        "itemid bigint, min double, max double",
    )
    rows = [event(1, 10, BASE, item, 1.0) for item in (1, 2, 3)]
    found = labs_in_window(frame(spark, "labevents", rows), anchor, Bounds.measured(table))
    assert [r.itemid for r in found.collect()] == [2, 2]


def test_vitals_need_a_clear_error_mark(spark):
    _, anchor = visit_anchor(spark)
    rows = [event(1, 10, BASE, 211, 80.0 + i, error=e) for i, e in enumerate((0, 1, None))]
    bounds = Bounds.from_rows(spark, fv.VITAL_BOUNDS)
    found = vitals_in_window(frame(spark, "chartevents", rows), anchor, bounds)
    assert [r.valuenum for r in found.collect()] == [80.0]
