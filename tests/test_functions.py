from datetime import datetime

import pytest

from anchorline import fixed_values as fv
from anchorline.config import DEFAULT_PARAMS, ExtractionParams
from anchorline.functions import (
    contains_any,
    elapsed_seconds,
    in_list,
    normalize_categories,
    normalize_enum,
)
from pyspark.sql import functions as F


def test_constants():
    p = DEFAULT_PARAMS
    assert (p.window_hours, p.gap_hours, p.min_los_hours) == (48, 6, 54)
    assert ExtractionParams(window_hours=24).min_los_hours == 30
    assert ExtractionParams(window_hours=24, min_los_hours=12).min_los_hours == 12
    assert (p.min_age, p.max_age) == (18, 89)
    assert (p.prolonged_los_days, p.readmission_days, p.mortality_days) == (7, 30, 30)
    assert fv.SECONDS_PER_YEAR == 365 * 24 * fv.SECONDS_PER_HOUR


def test_code_sets_are_disjoint_per_source():
    """The single-pass features give each event row one meaning."""
    from anchorline.plans.features import CHART_FEATURE_ITEMS

    assert len(set(CHART_FEATURE_ITEMS)) == len(CHART_FEATURE_ITEMS)
    assert not set(fv.VASOPRESSOR_ITEMS) & set(fv.SEDATION_ITEMS)


def test_code_set_sizes():
    assert len(fv.HEIGHT_INCH_ITEMS + fv.HEIGHT_CM_ITEMS) == 7
    assert len(fv.WEIGHT_KG_ITEMS + fv.WEIGHT_LB_ITEMS) == 7
    assert len(fv.VASOPRESSOR_ITEMS) == 17 and len(fv.SEDATION_ITEMS) == 12
    assert len(fv.PEEP_ITEMS) == 7 and len(fv.TIDAL_VOLUME_ITEMS) == 9
    assert len(fv.ANTIBIOTIC_KEYWORDS) == 10
    assert len(fv.LAB_BOUNDS) == 27 and len(fv.VITAL_BOUNDS) == 39
    assert [len(v) for v in fv.VOCABULARIES.values()] == [3, 9, 5, 13, 20, 7, 33]


def test_normalize_enum(spark):
    values = ["EMERGENCY", "emergency", "ELECTIVE", "UNKNOWN_TYPE", None, " ELECTIVE"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    allowed = ["EMERGENCY", "URGENT", "ELECTIVE"]
    rows = df.select("i", normalize_enum("v", allowed).alias("v")).orderBy("i").collect()
    assert [r.v for r in rows] == ["EMERGENCY", "EMERGENCY", "ELECTIVE", "OTHER", "OTHER", "OTHER"]


def test_normalize_categories_is_idempotent(spark):
    row = {name: words[0].lower() for name, words in fv.VOCABULARIES.items()}
    row["insurance"] = "self pay"
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in row))
    once = normalize_categories(df)
    assert once.collect() == normalize_categories(once).collect()
    assert once.collect()[0].insurance == "OTHER"
    assert once.collect()[0].ethnicity == "WHITE"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_elapsed_seconds_ignores_the_session_zone(spark, zone):
    previous = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist on that day in New York
        df = spark.createDataFrame(
            [(datetime(1998, 4, 5, 2, 30, 0, 250000), datetime(1998, 4, 5, 4, 30))],
            "a timestamp_ntz, b timestamp_ntz",
        )
        assert df.select(elapsed_seconds(F.col("a"), F.col("b"))).collect()[0][0] == 7199.75
        assert df.select(elapsed_seconds(F.col("b"), F.col("a"))).collect()[0][0] == -7199.75
    finally:
        spark.conf.set("spark.sql.session.timeZone", previous)


def test_in_list_quotes_and_handles_empty(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",), ("x",)], "v string")
    assert df.where(in_list("v", ["it's", "a\\b"])).count() == 2
    assert df.where(in_list("v", [])).count() == 0


def test_contains_any_takes_keywords_literally(spark):
    df = spark.createDataFrame([("A.B",), ("AxB",), (None,)], "v string")
    assert df.where(contains_any("v", ["a.b", "zzz"])).count() == 1
    assert df.where(contains_any("v", ["a.b"])).count() == 1
