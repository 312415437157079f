"""What is shuffled, written and sorted grows no faster than the tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from anchorline.operators import Anchor, PlanLimits, within_anchor
from anchorline.operators.anchored import of_known_keys
from anchorline.registry import queries
from anchorline.registry.queries import _Study
from anchorline.sources import retail
from anchorline.sources.retail import clinical_tables
from anchorline.sources.schemas import SOURCE_SCHEMAS

DAY = datetime(2100, 1, 1)


@pytest.fixture
def shop(spark, tmp_path):
    """2,000 orders of 100 customers, three lines each; one line and one order have no key."""
    folder = f"{tmp_path}/shop"
    rows = {
        "customer": [(c, f"c{c}", 0, 1.0, "F") for c in range(100)],
        "orders": [(o, o % 100, "O", 1.0, DAY + timedelta(hours=o), "5-LOW") for o in range(2000)]
        + [(None, 1, "O", 1.0, DAY, "5-LOW")],
        "lineitem": [
            (o, o * 3 + n, o % 7, n, 10.0 + n, 1.0, 0.0, 0.0, "N", "O", DAY) for o in range(2000) for n in (1, 2, 3)
        ]
        + [(None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", DAY)],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, retail.RETAIL_SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return folder


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_key_map_keeps_known_keys_and_drops_most_others(spark, kind):
    events = spark.range(100_000).selectExpr(f"CAST(IF(id = 7, NULL, id) AS {kind}) AS k")
    known = spark.range(0, 100_000, 10).selectExpr("id AS k").unionAll(spark.range(20).selectExpr("id * 10 AS k"))
    left = {r.k for r in of_known_keys(events, known, "k", known.count()).collect()}
    assert left >= set(range(0, 100_000, 10))
    assert len(left) < 10_000 + 90_000 / 8


def test_keys_that_are_no_integers_are_not_tested(spark):
    events = spark.createDataFrame([("1",), ("x",)], "k string")
    assert of_known_keys(events, spark.createDataFrame([(1,)], "k bigint"), "k", 1) is events


def test_events_of_other_visits_are_dropped_at_the_scan(spark, shop):
    tables = clinical_tables(spark, shop)
    visits = tables.admissions.where("hadm_id % 20 = 0").select("subject_id", "hadm_id", "admittime")

    def window(anchor):
        return within_anchor(tables.prescriptions, anchor, ["subject_id", "hadm_id"], "startdate", 48)

    mapped = window(Anchor.counted(visits, limits=PlanLimits(broadcast_rows=0)))
    plain = window(Anchor(visits))
    assert sorted(mapped.collect(), key=str) == sorted(plain.collect(), key=str) != []
    # the bit map is tested below the join of lines and orders, on both of its sides
    scans = optimized(mapped).split("Join Inner")[-1]
    assert scans.count("getbit") >= 2 and "getbit" not in optimized(plain)


def test_stored_tables_come_from_one_join(spark, shop, tmp_path):
    tables = clinical_tables(spark, shop, f"{tmp_path}/views")
    plain = clinical_tables(spark, shop)
    for name in SOURCE_SCHEMAS:
        stored, lazy = getattr(tables, name), getattr(plain, name)
        assert stored.schema == lazy.schema
        assert sorted(stored.collect(), key=str) == sorted(lazy.collect(), key=str) != []
    for name in retail._EVENTS:
        assert "Join" not in optimized(getattr(tables, name))
    assert len(list((tmp_path / "views").iterdir())) == 1


def test_tasks_of_the_line_join_grow_with_the_table(spark, shop, monkeypatch):
    plain = sorted(queries()["infusion_events"](spark, shop).collect(), key=str)
    monkeypatch.setattr(retail, "TASK_BYTES", 1000)
    divided = _Study(spark, shop).tables.labevents
    assert "REPARTITION_BY_NUM" in divided._jdf.queryExecution().executedPlan().toString()
    assert sorted(queries()["infusion_events"](spark, shop).collect(), key=str) == plain != []
