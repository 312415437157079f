"""Shape of the physical plans."""

import pytest

from anchorline import Bounds, ClinicalTables, extract, registry
from anchorline import fixed_values as fv
from anchorline.operators import Anchor
from anchorline.plans import features as f
from anchorline.plans.measures import vitals_in_window
from clinic import BASE, admission, event, frame, h, seed_two_stays, subject_ids, tables

QUERIES = registry.queries()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    plan = physical(QUERIES[name](spark, sf_dir))
    for banned in ("ArrowEval", "BatchEvalPython", "MapInPandas", "CartesianProduct",
                   "BroadcastNestedLoopJoin", "PythonUDF"):
        assert banned not in plan


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Clinical tables as parquet files, the shape a cluster reads."""
    root = str(tmp_path_factory.mktemp("clinic"))
    for name in ("chartevents", "inputevents_cv", "inputevents_mv", "prescriptions",
                 "procedureevents_mv", "microbiologyevents", "icustays"):
        time = {"inputevents_mv": "starttime", "procedureevents_mv": "starttime"}
        rows = [] if name != "chartevents" else [event(1, 10, BASE + h(1), 211, 80.0)]
        rows = rows or [event(1, 10, BASE, 1, time=time.get(name, "charttime"))]
        frame(spark, name, rows).write.parquet(f"{root}/{name}.parquet")
    return ClinicalTables.from_parquet(spark, root)


@pytest.fixture(scope="module")
def anchor(spark):
    return Anchor(frame(spark, "admissions", [admission(1, 10)]), max_rows=1)


def scans(plan: str, table: str) -> list[str]:
    return [
        line for line in plan.splitlines() if "FileScan parquet" in line and f"{table}.parquet" in line
    ]


@pytest.fixture(autouse=True)
def wide_plan_text(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "200")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_features_read_each_event_table_once(spark, stored, anchor):
    plan = "".join(physical(df) for df in f.feature_tables(stored, anchor))
    for table in ("chartevents", "inputevents_cv", "inputevents_mv", "prescriptions",
                  "procedureevents_mv", "microbiologyevents"):
        assert len(scans(plan, table)) == 1, table


def test_item_filter_and_columns_reach_the_scan(spark, stored, anchor):
    _, chart = f.feature_tables(stored, anchor)
    (scan,) = scans(physical(chart), "chartevents")
    pushed = scan[scan.index("PushedFilters") :]
    assert "In(itemid" in pushed and "EqualTo(error,0)" in pushed
    bounds = Bounds.from_rows(spark, fv.VITAL_BOUNDS)
    vitals = physical(vitals_in_window(stored.chartevents, anchor, bounds))
    (scan,) = scans(vitals, "chartevents")
    pushed = scan[scan.index("PushedFilters") :]
    assert "In(itemid" in pushed and "EqualTo(error,0)" in pushed and "IsNotNull(valuenum)" in pushed
    schema = scan[scan.index("ReadSchema") :]
    assert "value:string" not in schema and "valuenum" in schema


def test_small_anchor_keeps_measurements_unshuffled(spark, stored, anchor):
    bounds = Bounds.from_rows(spark, fv.VITAL_BOUNDS)
    plan = physical(vitals_in_window(stored.chartevents, anchor, bounds))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_only_chart_rows_are_sorted(spark, stored, anchor):
    treatments, chart = f.feature_tables(stored, anchor)
    assert "SortAggregate" not in physical(treatments)
    assert not scans(physical(treatments), "chartevents")
    assert "SortAggregate" in physical(chart)
    charted = stored.chartevents
    treatments, readings, flags = f.feature_tables(stored, anchor, charted=charted)
    assert "SortAggregate" not in physical(treatments) + physical(flags)
    (scan,) = scans(physical(readings), "chartevents")
    assert "In(itemid" in scan or "itemid" in scan[scan.index("ReadSchema") :]


@pytest.fixture(scope="module")
def seed(spark, tmp_path_factory):
    from anchorline.sources.schemas import SOURCE_SCHEMAS

    root = str(tmp_path_factory.mktemp("seed"))
    rows = seed_two_stays()
    for name in SOURCE_SCHEMAS:
        frame(spark, name, rows.get(name, [])).write.parquet(f"{root}/{name}.parquet")
    return ClinicalTables.from_parquet(spark, root)


def test_the_span_of_the_study_reaches_the_scans(spark, seed):
    bounds = Bounds.from_rows(spark, fv.LAB_BOUNDS)
    result = extract(seed, subject_ids(spark, [1, 2, 3]), bounds, bounds)
    (scan,) = scans(physical(result.labs), "labevents")
    pushed = scan[scan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(charttime,2100-01-01" in pushed
    assert "LessThanOrEqual(charttime,2100-01-" in pushed
    assert result.labs.count() == 20


def test_long_bounds_are_staged_by_one_read_too(spark, seed):
    """10,001 bounds: no literal IN, the same rows, and the chart table is read once."""
    few = Bounds.from_rows(spark, fv.VITAL_BOUNDS)
    surplus = spark.range(5_000_000, 5_010_001).selectExpr("id AS itemid", "0D AS min", "1D AS max")
    many = Bounds.measured(few.frame.select("itemid", "min", "max").unionByName(surplus))
    assert many.items is None and few.items is not None
    labs = Bounds.from_rows(spark, fv.LAB_BOUNDS)
    ids = subject_ids(spark, [1, 2, 3])
    expected, got = extract(seed, ids, labs, few), extract(seed, ids, labs, many)
    assert sorted(got.vitals.collect()) == sorted(expected.vitals.collect())
    assert sorted(map(str, got.cohort.collect())) == sorted(map(str, expected.cohort.collect()))
    # what is left of the chart table in the plans is the stage
    for name in ("vitals", "cohort"):
        assert not scans(physical(getattr(got, name)), "chartevents")
