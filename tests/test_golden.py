"""Hand-computed results for two small seeds, staged and lazy."""

from datetime import datetime

import pytest

from anchorline import Bounds, ExtractionParams, extract
from anchorline import fixed_values as fv
from anchorline.sources.schemas import (
    COHORT_COLUMNS,
    FEATURE_COLUMNS,
    MEASURE_COLUMNS,
    TARGET_COLUMNS,
)
from clinic import BASE, admission, d, event, h, patient, seed_two_stays, subject_ids, tables


def run(spark, rows, ids, stage):
    return extract(
        tables(spark, **rows),
        subject_ids(spark, ids),
        Bounds.from_rows(spark, fv.LAB_BOUNDS),
        Bounds.from_rows(spark, fv.VITAL_BOUNDS),
        stage=stage,
    )


@pytest.fixture(scope="module", params=[True, False], ids=["staged", "lazy"])
def two_stays(spark, request):
    return run(spark, seed_two_stays(), [1, 2, 3], request.param)


def by_subject(df):
    return {row.subject_id: row for row in df.collect()}


def test_cohort(two_stays):
    cohort = by_subject(two_stays.cohort)
    assert set(cohort) == {1, 3}
    assert two_stays.cohort.columns == COHORT_COLUMNS + FEATURE_COLUMNS
    assert cohort[1].hadm_id == 101 and cohort[3].hadm_id == 103
    assert cohort[1].first_icu_intime == BASE + h(10)
    assert cohort[3].first_icu_intime is None
    assert cohort[1].height_cm == pytest.approx(177.8)
    assert cohort[1].weight_kg == 80.0
    assert cohort[3].height_cm == 175.0
    assert cohort[3].weight_kg == pytest.approx(81.6466266)
    flags = FEATURE_COLUMNS[3:]
    assert [cohort[1][name] for name in flags] == [1, 0, 1, 1, 1, 1]
    assert [cohort[3][name] for name in flags] == [0, 0, 1, 0, 0, 0]
    assert dict(two_stays.cohort.dtypes)["received_rrt"] == "int"


def test_targets(two_stays):
    targets = by_subject(two_stays.targets)
    assert two_stays.targets.columns == TARGET_COLUMNS
    # death exactly 30 days after discharge still counts
    assert tuple(targets[1])[2:] == (1, 1, 1)
    assert tuple(targets[3])[2:] == (0, 0, 1)


def test_measurements(two_stays):
    window = {1: BASE, 3: BASE + d(2)}
    for frame, expected, bounds in (
        (two_stays.labs, 10, fv.LAB_BOUNDS),
        (two_stays.vitals, 18, fv.VITAL_BOUNDS),
    ):
        assert frame.columns == MEASURE_COLUMNS
        rows = frame.collect()
        limits = {item: (low, high) for item, low, high in bounds}
        for subject in (1, 3):
            mine = [row for row in rows if row.subject_id == subject]
            assert len(mine) == expected
            for row in mine:
                assert window[subject] <= row.charttime <= window[subject] + h(48)
                low, high = limits[row.itemid]
                assert low <= row.valuenum <= high


def test_attrition(two_stays):
    counts = dict(two_stays.attrition.collect())
    assert counts["listed"] == 3 and counts["admissions"] == 5 and counts["candidates"] == 3
    assert counts["kept"] == 2 and counts["excluded"] == 1
    assert counts["excluded:age"] == 1 and counts["excluded:survived"] == 0


def test_thresholds_are_parameters(spark):
    result = extract(
        tables(spark, **seed_two_stays()),
        subject_ids(spark, [1, 2, 3]),
        Bounds.from_rows(spark, fv.LAB_BOUNDS),
        Bounds.from_rows(spark, fv.VITAL_BOUNDS),
        ExtractionParams(
            window_hours=5,
            min_age=16,
            min_los_hours=60,
            mortality_days=29,
            prolonged_los_days=2,
            readmission_days=10,
        ),
    )
    targets = by_subject(result.targets)
    assert {s: tuple(row)[2:] for s, row in targets.items()} == {1: (0, 1, 0), 2: (0, 1, 0)}
    (one, two) = (by_subject(result.cohort)[s] for s in (1, 2))
    assert [one[name] for name in FEATURE_COLUMNS[3:]] == [0, 0, 1, 1, 0, 0]
    assert one.first_icu_intime is None and two.height_cm is None
    assert result.labs.count() == 2 and result.vitals.count() == 2


@pytest.mark.parametrize("stage", [True, False])
def test_minimal_seed(spark, stage):
    admit = BASE
    rows = {
        "admissions": [
            admission(1, 10, admit, d(10)),
            admission(2, 20, datetime(2100, 1, 5), h(60)),
        ],
        "patients": [
            patient(1, datetime(2040, 1, 1), admit + d(30), "M"),
            patient(2, datetime(2090, 1, 1)),
        ],
        "icustays": [{"hadm_id": 10, "intime": admit + h(10)}],
        "chartevents": [
            event(1, 10, admit + h(2), 920, 70.0),
            event(1, 10, admit + h(3), 762, 80.0),
            event(1, 10, admit + h(5), 467, None, "Ventilator"),
            event(1, 10, admit + h(6), 223849, 1.0, "AC"),
            event(1, 10, admit + h(1), 211, 80.0),
        ],
        "inputevents_cv": [event(1, 10, admit + h(8), 221906)],
        "inputevents_mv": [event(1, 10, admit + h(9), 221749, time="starttime")],
        "prescriptions": [
            {"subject_id": 1, "hadm_id": 10, "startdate": admit + h(4), "drug": "Vancomycin"}
        ],
        "procedureevents_mv": [event(1, 10, admit + h(7), 225802, time="starttime")],
        "microbiologyevents": [
            {
                "subject_id": 1,
                "hadm_id": 10,
                "spec_type_desc": "Blood Culture",
                "org_name": "E. coli",
                "charttime": admit + h(12),
            }
        ],
        "labevents": [event(1, 10, admit + h(2), 50912, 1.2), event(1, 10, admit + h(3), 51222, 13.5)],
    }
    result = run(spark, rows, [1, 2, 3], stage)
    (cohort,) = result.cohort.collect()
    assert (cohort.subject_id, cohort.hadm_id) == (1, 10)
    assert cohort.first_icu_intime is not None and cohort.height_cm > 100 and cohort.weight_kg > 0
    assert [cohort[name] for name in FEATURE_COLUMNS[3:]] == [1, 0, 1, 1, 1, 1]
    (target,) = result.targets.collect()
    assert tuple(target) == (1, 10, 1, 1, 0)
    assert sorted(row.valuenum for row in result.labs.collect()) == [1.2, 13.5]
    assert [row.valuenum for row in result.vitals.collect()] == [80.0]


@pytest.mark.parametrize("stage", [True, False])
def test_empty_tables(spark, stage):
    result = run(spark, {}, [1], stage)
    for frame in (*result.outputs().values(),):
        assert frame.count() == 0
    assert result.cohort.columns == COHORT_COLUMNS + FEATURE_COLUMNS
    assert dict(result.attrition.collect())["kept"] == 0


@pytest.mark.parametrize("stage", [True, False])
def test_cohort_without_events(spark, stage):
    rows = {"admissions": [admission(1, 10)], "patients": [patient(1)]}
    result = run(spark, rows, [1], stage)
    (row,) = result.cohort.collect()
    assert [row[name] for name in FEATURE_COLUMNS] == [None, None, None, 0, 0, 0, 0, 0, 0]
    assert result.labs.count() == 0 and result.vitals.count() == 0
