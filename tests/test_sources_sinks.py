from datetime import datetime, timedelta

import pandas as pd
import pytest

from anchorline import Bounds, ClinicalTables, extract, load_bounds, load_subjects, write_outputs
from anchorline import fixed_values as fv
from anchorline.operators import shared_folder, sizing, staged
from anchorline.plans import cohort as c
from anchorline.sources.schemas import SOURCE_SCHEMAS
from anchorline.sources.sinks import CSV_OPTIONS
from clinic import BASE, admission, d, frame, h, patient, seed_two_stays, subject_ids, tables


def test_subject_list_keeps_repeats_and_ignores_other_columns(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("note,subject_id\na,5\nb,7\nc,5\n")
    df = load_subjects(spark, str(tmp_path / "ids.csv"))
    assert df.dtypes == [("subject_id", "bigint")]
    assert sorted(r[0] for r in df.collect()) == [5, 5, 7]


def test_bounds_are_read_by_name(spark, tmp_path):
    path = tmp_path / "bounds.csv"
    path.write_text(
        "itemid,measurement name,feature name,min,max,units,category\n"
        "50885,BILIRUBIN; TOTAL,BILIRUBIN,0,20,mg/dL,CHEMISTRY\n"
        "51237,INR(PT),INR,0.5,10,,HEMATOLOGY\n"
    )
    bounds = load_bounds(spark, str(path))
    assert sorted(map(tuple, bounds.frame.collect())) == [(50885, 0.0, 20.0), (51237, 0.5, 10.0)]
    assert bounds.items == (50885, 51237)


def test_long_bounds_are_not_collected(spark, monkeypatch):
    monkeypatch.setattr("anchorline.sources.metadata.LOOKUP_ROWS", 2)
    frame_ = spark.createDataFrame([(i, 0.0, 1.0) for i in range(3)], "itemid bigint, min double, max double")
    assert Bounds.measured(frame_).items is None
    assert Bounds.from_rows(spark, [(i, 0, 1) for i in range(3)]).items is None


def test_bounds_from_rows_keep_every_number(spark):
    rows = [(1, 0.1, 1e-07), (2, float("-inf"), float("inf")), (3, None, 5.0)]
    assert sorted(map(tuple, Bounds.from_rows(spark, rows).frame.collect())) == rows
    empty = Bounds.from_rows(spark, [])
    assert empty.frame.count() == 0 and empty.items == ()


def test_unmeasured_bounds_give_the_same_vitals(spark):
    plain = Bounds(Bounds.from_rows(spark, fv.VITAL_BOUNDS).frame)
    labs = Bounds.from_rows(spark, fv.LAB_BOUNDS)
    t = tables(spark, **seed_two_stays())
    assert extract(t, subject_ids(spark, [1, 3]), labs, plain).vitals.count() == 36


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_outputs_round_trip_with_counts(spark, tmp_path, fmt):
    result = extract(
        tables(spark, **seed_two_stays()),
        subject_ids(spark, [1, 2, 3]),
        Bounds.from_rows(spark, fv.LAB_BOUNDS),
        Bounds.from_rows(spark, fv.VITAL_BOUNDS),
    )
    outputs = result.outputs()
    for _ in range(2):  # the second run overwrites the first
        counts = write_outputs(outputs, str(tmp_path), fmt)
    assert counts == {"cohort": 2, "labs": 20, "vitals": 36, "targets": 2}
    for name, df in outputs.items():
        reader = spark.read.schema(df.schema)
        reader = reader.options(**CSV_OPTIONS) if fmt == "csv" else reader
        back = reader.format(fmt).load(f"{tmp_path}/{name}")
        assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_csv_reads_the_same_outside_spark(spark, tmp_path):
    text = 'say "a, b"'
    rows = [(1, text, BASE + h(1.5), None), (2, None, None, 0.1)]
    df = spark.createDataFrame(rows, "i int, s string, t timestamp_ntz, x double").coalesce(1)
    assert write_outputs({"odd": df}, str(tmp_path), "csv") == {"odd": 2}
    (part,) = (tmp_path / "odd").glob("*.csv")
    back = pd.read_csv(part, parse_dates=["t"])
    assert list(back.columns) == ["i", "s", "t", "x"]
    assert back.s[0] == text and back.t[0] == BASE + h(1.5) and back.x[1] == 0.1
    assert back.isna().sum().sum() == 3


def test_empty_outputs_are_counted(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    assert write_outputs({"none": empty}, str(tmp_path)) == {"none": 0}


def test_clinical_tables_from_files(spark, tmp_path):
    rows = seed_two_stays()
    for name in SOURCE_SCHEMAS:
        df = frame(spark, name, rows.get(name, []))
        df.write.parquet(f"{tmp_path}/pq/{name}.parquet")
        # exports often come in capitals and in another order
        upper = df.select(*[df[col].alias(col.upper()) for col in reversed(df.columns)])
        upper.write.option("header", True).csv(f"{tmp_path}/csv/{name}.csv")
    for t in (
        ClinicalTables.from_parquet(spark, f"{tmp_path}/pq"),
        ClinicalTables.from_csv(spark, f"{tmp_path}/csv"),
    ):
        for name, schema in SOURCE_SCHEMAS.items():
            got = getattr(t, name)
            assert [(x.name, x.dataType) for x in got.schema] == [
                (x.name, x.dataType) for x in schema
            ]
            assert got.count() == len(rows.get(name, []))
        index = c.index_admissions(t.admissions, t.patients, subject_ids(spark, [1, 2, 3]), 3)
        assert c.select_cohort(index).count() == 2
        with pytest.raises(AttributeError):
            t.no_such_table


def test_clinical_tables_from_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS clinic_test")
    frame(spark, "patients", [patient(1)]).write.mode("overwrite").saveAsTable("clinic_test.patients")
    try:
        assert ClinicalTables.from_catalog(spark, "clinic_test").patients.count() == 1
    finally:
        spark.sql("DROP DATABASE clinic_test CASCADE")


def test_staged_frames_keep_schema_and_rows(spark):
    df = frame(spark, "admissions", [admission(1, 10), admission(2, 20, None)])
    back = staged(df, f"{shared_folder(spark)}/anchorline-tests", "adm")
    assert back.dtypes == df.dtypes and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_a_run_can_remove_its_own_stage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("anchorline.plans.extraction.shared_folder", lambda _: str(tmp_path))
    bounds = Bounds.from_rows(spark, fv.LAB_BOUNDS)
    t = tables(spark, **seed_two_stays())
    first, second = (extract(t, subject_ids(spark, [1, 3]), bounds, bounds) for _ in range(2))
    assert len(list((tmp_path / "anchorline").iterdir())) == 2
    first.discard_stage()
    assert len(list((tmp_path / "anchorline").iterdir())) == 1
    assert second.cohort.count() == 2


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("zone,shift", [("UTC", 0), ("Europe/Berlin", 1)])
def test_stored_instants_do_not_depend_on_the_session(spark, tmp_path, session_zone, zone, shift):
    """Both sides of a clock change, once around New York's repeated hour."""
    before = spark.conf.get("spark.sql.session.timeZone")
    micros = [1_730_610_000_000_000 + n * 1_800_000_000 + 123_456 for n in range(8)]  # 2024-11-03 05:00 UTC on
    rows = spark.createDataFrame([(n, m) for n, m in enumerate(micros)], "hadm_id int, m bigint")
    path = f"{tmp_path}/icustays.parquet"
    try:
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        rows.selectExpr("hadm_id", "timestamp_micros(m) AS intime").write.parquet(path)
        got = ClinicalTables.from_parquet(spark, str(tmp_path), source_zone=zone).icustays
        assert got.schema["intime"].dataType.typeName() == "timestamp_ntz"
        start = datetime(2024, 11, 3, 5 + shift, 0, 0, 123_456)
        assert [r.intime for r in got.orderBy("hadm_id").collect()] == [
            start + timedelta(minutes=30 * n) for n in range(8)
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_repeated_patients_are_one_subject(spark):
    people = [patient(1), patient(1, gender="M"), patient(1), patient(2), patient(2, died=BASE + d(9))]
    t = tables(
        spark,
        admissions=[admission(1, 10), admission(1, 11, BASE + d(20)), admission(2, 20)],
        patients=people,
    )
    index = c.index_admissions(t.admissions, t.patients)
    from_base = c.index_from_base(c.base_admissions(t.admissions, t.patients))
    assert sorted(map(str, index.select(sorted(index.columns)).collect())) == sorted(
        map(str, from_base.select(sorted(index.columns)).collect())
    )
    rows = {r.subject_id: r for r in index.collect()}
    assert len(rows) == index.count() == 2
    assert rows[1].gender == "F" and rows[1].next_admittime == BASE + d(20)
    assert rows[2].dod == BASE + d(9)
    report = c.attrition(c.base_admissions(t.admissions, t.patients), index, patients=t.patients)
    assert {r.step: r.n for r in report.collect()}["repeated_patients"] == 3


class StubSession:
    """Only what `shared_folder` reads."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = {f"spark.{k.replace('_', '.')}": v for k, v in settings.items()}

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_shared_folder_comes_from_the_session():
    assert shared_folder(StubSession(checkpoint_dir="/shared/folder/")) == "/shared/folder"
    assert shared_folder(StubSession(master="local[4]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(StubSession(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(StubSession(master="local-cluster[2,1,1024]"))


def test_broadcast_needs_a_counted_bound(spark):
    df = spark.range(3)
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(sizing.small_side(df, 3))
    assert not hinted(sizing.small_side(df, None))
    assert not hinted(sizing.small_side(df, sizing.BROADCAST_ROWS + 1))


def test_base_admissions_shape(spark):
    t = tables(spark, admissions=[admission(1, 10), admission(2, 20)], patients=[patient(1), patient(2)])
    base = c.base_admissions(t.admissions, t.patients, subject_ids(spark, [1, 1]), 2)
    (row,) = base.collect()
    assert len(base.columns) == 16 and row.hadm_id == 10 and row.edregtime == BASE.replace(
        year=2099, month=12, day=31, hour=23
    )
    assert isinstance(row.admittime, datetime)
    # without a list every patient's admissions count
    assert c.base_admissions(t.admissions, t.patients).count() == 2
