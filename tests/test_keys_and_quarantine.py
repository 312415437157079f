import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorline.operators import key_audit, one_per_key, repeated_keys
from anchorline.plans.models import LogisticModel, load_models, save_models
from anchorline.sources.quarantine import conform_leniently, conform_strictly, rejected_values

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("at", T.TimestampNTZType()), T.StructField("name", T.StringType())])


def test_keys_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 5, 6]), rng.choice("ab")) for _ in range(60)] + [(9, 1, "z")]
    df = spark.createDataFrame(rows, "k long, o long, v string").repartition(4)
    copies = {k: sum(r[0] == k for r in rows) for k in {r[0] for r in rows}}
    missing = copies.pop(None, 0)
    repeated = {k: n for k, n in copies.items() if n > 1}
    assert {r.k: r.copies for r in repeated_keys(df, "k").collect()} == repeated
    (audit,) = key_audit(df, "k", "t").collect()
    assert tuple(audit) == ("t", 61, missing, len(copies), len(repeated), sum(n - 1 for n in copies.values()))
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r[1:])
    best = [min((r for r in rows if r[0] == k), key=order) for k in copies] + [r for r in rows if r[0] is None]
    got = one_per_key(df, "k", ["o"])
    assert got.columns == df.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, best))


def test_audit_of_an_empty_table(spark):
    (audit,) = key_audit(spark.createDataFrame([], "k long"), "k", "t").collect()
    assert tuple(audit) == ("t", 0, 0, 0, 0, 0)


def test_bad_cells_are_null_and_counted(spark):
    rows = [("1", "2020-01-01", "a"), ("x", "2020-01-01", "b"), ("x", "never", None), (None, None, "c"), ("7.5", "", "")]
    df = spark.createDataFrame(rows, "ID string, at string, name string")
    got = {(r.column_name, r.value): r.cells for r in rejected_values(df, SCHEMA, "t").collect()}
    assert got == {("id", "x"): 2, ("id", "7.5"): 1, ("at", "never"): 1, ("at", ""): 1}
    kept = conform_leniently(df, SCHEMA)
    assert kept.schema.fieldNames() == ["id", "at", "name"]
    assert sorted((r.id or 0, r.at is None, r.name or "") for r in kept.collect()) == [(0, False, "b"), (0, True, ""), (0, True, ""), (0, True, "c"), (1, False, "a")]
    with pytest.raises(ValueError, match="2 bad cells in at, 3 bad cells in id"):
        conform_strictly(df, SCHEMA, "t")
    assert conform_strictly(df.limit(1), SCHEMA, "t").count() == 1


def test_saved_models_fill_missing_features(spark, tmp_path):
    model = LogisticModel(-1.0, {"a": 0.5, "b": 2.0}, {"a": 3.0})
    save_models(dict.fromkeys(("mortality", "prolonged_los", "readmission_30d"), model.pipeline()), str(tmp_path))
    rows = [(1.0, 1), (None, 0), (math.nan, None)]
    df = spark.createDataFrame(rows, "a double, b int")
    got = [r.probability for r in load_models(str(tmp_path))["mortality"].transform(df).collect()]
    margins = [-1 + 0.5 * 1 + 2, -1 + 1.5, -1 + 1.5]
    assert got == pytest.approx([1 / (1 + math.exp(-m)) for m in margins])
