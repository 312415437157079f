"""Declared schemas of the clinical source tables and column lists of the outputs.

Fixed values: names, types and order are the contract with stored tables and
with readers of the results.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "ts": T.TimestampNTZType(),
    "double": T.DoubleType(),
    "str": T.StringType(),
}


def _schema(spec: str) -> T.StructType:
    """``"name:type, name:type"`` to a nullable StructType."""
    fields = [part.strip().split(":") for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


SOURCE_SCHEMAS = {
    "admissions": _schema(
        "subject_id:int, hadm_id:int, admittime:ts, dischtime:ts, admission_type:str,"
        "admission_location:str, insurance:str, language:str, religion:str,"
        "marital_status:str, ethnicity:str, edregtime:ts, has_chartevents_data:int"
    ),
    "patients": _schema("subject_id:int, gender:str, dob:ts, dod:ts"),
    "icustays": _schema("hadm_id:int, intime:ts"),
    "chartevents": _schema(
        "subject_id:int, hadm_id:int, charttime:ts, itemid:int,"
        "valuenum:double, value:str, error:int"
    ),
    "inputevents_cv": _schema("subject_id:int, hadm_id:int, charttime:ts, itemid:int"),
    "inputevents_mv": _schema("subject_id:int, hadm_id:int, starttime:ts, itemid:int"),
    "prescriptions": _schema("subject_id:int, hadm_id:int, startdate:ts, drug:str"),
    "procedureevents_mv": _schema("subject_id:int, hadm_id:int, starttime:ts, itemid:int"),
    "microbiologyevents": _schema(
        "subject_id:int, hadm_id:int, spec_type_desc:str, org_name:str, charttime:ts"
    ),
    "labevents": _schema(
        "subject_id:int, hadm_id:int, charttime:ts, itemid:int, valuenum:double"
    ),
}

BASE_COLUMNS = [
    "subject_id", "hadm_id", "admittime", "dischtime", "admission_type",
    "admission_location", "insurance", "language", "religion", "marital_status",
    "ethnicity", "edregtime", "has_chartevents_data", "gender", "dob", "dod",
]
COHORT_COLUMNS = [
    "subject_id", "hadm_id", "admittime", "admission_type", "admission_location",
    "insurance", "language", "religion", "marital_status", "ethnicity",
    "edregtime", "gender", "admission_age",
]
FEATURE_COLUMNS = [
    "first_icu_intime", "height_cm", "weight_kg", "received_vasopressor",
    "received_sedation", "received_antibiotic", "was_mechanically_ventilated",
    "received_rrt", "positive_blood_culture",
]
TARGET_COLUMNS = ["subject_id", "hadm_id", "mortality", "prolonged_los", "readmission_30d"]
MEASURE_COLUMNS = ["subject_id", "hadm_id", "charttime", "itemid", "valuenum"]
