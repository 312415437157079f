"""Whole extraction against the plain-Python reading, on random clinics."""

import pytest

from anchorline import Bounds, extract
from anchorline import fixed_values as fv
from anchorline.operators import Anchor
from anchorline.plans import cohort as c
from anchorline.plans import features as f
from brute import expected, random_clinic
from clinic import subject_ids, tables

COHORT = ["subject_id", "hadm_id", "insurance", "admission_age", "first_icu_intime",
          "height_cm", "weight_kg", "received_vasopressor", "received_sedation",
          "received_antibiotic", "was_mechanically_ventilated", "received_rrt",
          "positive_blood_culture"]


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed,stage", [(1, True), (2, False), (3, True)])
def test_extraction(spark, seed, stage):
    rows = random_clinic(seed)
    listed = list(range(1, 115)) + [5, 5, 999]
    want = expected(rows, listed)
    got = extract(
        tables(spark, **rows),
        subject_ids(spark, listed),
        Bounds.from_rows(spark, fv.LAB_BOUNDS),
        Bounds.from_rows(spark, fv.VITAL_BOUNDS),
        stage=stage,
    )
    assert all(len(want[name]) > 10 for name in want)
    assert bag(got.cohort.select(*COHORT).collect()) == bag(want["cohort"])
    for name in ("targets", "labs", "vitals"):
        assert bag(getattr(got, name).collect()) == bag(want[name]), name


def test_single_features_agree_with_the_single_pass(spark):
    """Nine separate operators, shuffled joins: same columns as the one-pass table."""
    rows = random_clinic(4)
    t = tables(spark, **rows)
    listed = sorted({a["subject_id"] for a in rows["admissions"]})
    index = c.index_admissions(t.admissions, t.patients, subject_ids(spark, listed), None)
    selected = c.select_cohort(index)
    anchor = Anchor(selected.select("subject_id", "hadm_id", "admittime"))
    cohort = c.cohort_columns(selected)
    one_by_one = f.add_first_icu_intime(cohort, t.icustays, anchor)
    one_by_one = f.add_first_height(one_by_one, t.chartevents, anchor)
    one_by_one = f.add_first_weight(one_by_one, t.chartevents, anchor)
    inputs = (t.inputevents_cv, t.inputevents_mv)
    one_by_one = f.add_received_vasopressor(one_by_one, *inputs, anchor)
    one_by_one = f.add_received_sedation(one_by_one, *inputs, anchor)
    one_by_one = f.add_received_antibiotic(one_by_one, t.prescriptions, anchor)
    one_by_one = f.add_was_mechanically_ventilated(one_by_one, t.chartevents, anchor)
    one_by_one = f.add_received_rrt(one_by_one, t.procedureevents_mv, t.chartevents, anchor)
    one_by_one = f.add_positive_blood_culture(one_by_one, t.microbiologyevents, anchor)
    together = f.add_all_features(cohort, t, anchor)
    assert one_by_one.schema == together.schema
    assert bag(one_by_one.collect()) == bag(together.collect())
    assert bag(one_by_one.select(*COHORT).collect()) == bag(expected(rows, listed)["cohort"])
