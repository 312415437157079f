import pytest
from pyspark.sql import functions as F

from anchorline.sources import current, publish


def frames(spark, n):
    a = spark.range(n).select("id", (F.col("id") / 4).alias("x"), F.lit("t").alias("s"))
    return {"a": a, "b": spark.range(3).withColumn("when", F.lit("2020-01-02 03:04:05.25").cast("timestamp_ntz")), "c": spark.range(0)}


def test_counts_and_digests_do_not_depend_on_order(spark, tmp_path):
    first = publish(frames(spark, 40), f"{tmp_path}/one")
    again = publish({k: v.repartition(3).sort(F.desc("id")) for k, v in frames(spark, 40).items()}, f"{tmp_path}/two")
    rows = sorted(map(tuple, first.manifest.collect()))
    assert rows == sorted(map(tuple, again.manifest.collect()))
    assert [r[:2] for r in rows] == [("a", 40), ("b", 3), ("c", 0)] and rows[2][2] == "0"
    assert first.damaged() == [] and first.table("a").count() == 40


def test_a_failure_leaves_the_earlier_set(spark, tmp_path):
    publish(frames(spark, 5), str(tmp_path))
    bad = frames(spark, 9)
    bad["c"] = spark.range(1).select(F.raise_error(F.lit("the third table fails")).cast("long").alias("id"))
    with pytest.raises(Exception, match="third table"):
        publish(bad, str(tmp_path))
    seen = current(spark, str(tmp_path))
    assert seen.table("a").count() == 5 and seen.damaged() == []
    assert publish(frames(spark, 9), str(tmp_path)).table("a").count() == 9
    assert current(spark, str(tmp_path)).table("a").count() == 9


def test_a_changed_table_is_found(spark, tmp_path):
    done = publish(frames(spark, 5), str(tmp_path))
    spark.range(5).select("id", F.lit(0.5).alias("x"), F.lit("t").alias("s")).write.mode("overwrite").parquet(f"{done.folder}/a")
    assert done.damaged() == ["a"]


def test_nothing_published(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        current(spark, f"{tmp_path}/none")
