"""Small clinical fixtures: rows as dicts, everything not named is NULL."""

from __future__ import annotations

from datetime import datetime, timedelta

from anchorline.sources.schemas import SOURCE_SCHEMAS
from anchorline.sources.tables import ClinicalTables

BASE = datetime(2100, 1, 1)


def h(n: float) -> timedelta:
    return timedelta(hours=n)


def d(n: float) -> timedelta:
    return timedelta(days=n)


def frame(spark, table: str, rows):
    schema = SOURCE_SCHEMAS[table]
    return spark.createDataFrame(
        [tuple(row.get(field.name) for field in schema.fields) for row in rows], schema
    )


def tables(spark, **rows) -> ClinicalTables:
    return ClinicalTables(lambda name: frame(spark, name, rows.get(name, [])))


def subject_ids(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "subject_id bigint")


def admission(subject, hadm, admit=BASE, stay=d(5), **over):
    row = {
        "subject_id": subject,
        "hadm_id": hadm,
        "admittime": admit,
        "dischtime": None if admit is None else admit + stay,
        "admission_type": "EMERGENCY",
        "admission_location": "EMERGENCY ROOM ADMIT",
        "insurance": "MEDICARE",
        "language": "ENGL",
        "religion": "CATHOLIC",
        "marital_status": "MARRIED",
        "ethnicity": "WHITE",
        "edregtime": None if admit is None else admit - h(1),
        "has_chartevents_data": 1,
    }
    return {**row, **over}


def patient(subject, born=BASE - d(50 * 365), died=None, gender="F"):
    return {"subject_id": subject, "gender": gender, "dob": born, "dod": died}


def event(subject, hadm, at, item=None, value=None, text=None, error=0, time="charttime"):
    return {
        "subject_id": subject,
        "hadm_id": hadm,
        time: at,
        "itemid": item,
        "valuenum": value,
        "value": text,
        "error": error,
    }


# The golden seed, whose results are known.
def seed_two_stays():
    """Three subjects: 1 and 3 qualify, 2 is too young; 1 and 3 come back within 30 days."""
    one, two, three = BASE, BASE + d(1), BASE + d(2)
    rows = {
        "admissions": [
            admission(1, 101, one, d(10)),
            admission(2, 102, two, d(3)),
            admission(3, 103, three, h(54)),
            admission(1, 108, BASE + d(30), d(3)),
            admission(3, 1103, BASE + d(20), d(2)),
        ],
        "patients": [
            patient(1, one - d(65 * 365.25), BASE + d(40), "M"),
            patient(2, two - d(17 * 365.25)),
            patient(3, three - d(50 * 365.25), gender="M"),
        ],
        "icustays": [{"hadm_id": 101, "intime": one + h(10)}],
        "chartevents": [
            event(1, 101, one + h(2), 920, 70.0),
            event(3, 103, three + h(2), 3485, 175.0),
            event(1, 101, one + h(3), 762, 80.0),
            event(3, 103, three + h(3), 3581, 180.0),
            event(1, 101, one + h(5), 467, None, "Ventilator"),
            event(1, 101, one + h(6), 223849, 1.0, "AC"),
        ],
        "inputevents_cv": [event(1, 101, one + h(8), 221906)],
        "inputevents_mv": [event(1, 101, one + h(9), 221749, time="starttime")],
        "prescriptions": [
            {"subject_id": 1, "hadm_id": 101, "startdate": one + h(4), "drug": "Vancomycin"},
            {
                "subject_id": 3,
                "hadm_id": 103,
                "startdate": three + h(6),
                "drug": "Piperacillin/Tazobactam",
            },
        ],
        "procedureevents_mv": [event(1, 101, one + h(7), 225802, time="starttime")],
        "microbiologyevents": [
            {
                "subject_id": 1,
                "hadm_id": 101,
                "spec_type_desc": "Blood Culture",
                "org_name": "E. coli",
                "charttime": one + h(12),
            }
        ],
        "labevents": [],
    }
    for i, (subject, hadm, admit) in enumerate([(1, 101, one), (3, 103, three)]):
        for hour in (2, 12, 24, 36, 47):
            rows["labevents"].append(event(subject, hadm, admit + h(hour), 50912, 1 + hour * 0.1))
            rows["labevents"].append(event(subject, hadm, admit + h(hour), 51222, 12 + i * 0.5))
        for hour in (1, 6, 12, 18, 24, 30, 36, 42, 47):
            rows["chartevents"].append(event(subject, hadm, admit + h(hour), 211, 70 + hour * 0.5))
            rows["chartevents"].append(event(subject, hadm, admit + h(hour), 51, 120.0 + i * 5))
    return rows
