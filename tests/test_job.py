from anchorline.job import main, run_job
from anchorline.sources.schemas import SOURCE_SCHEMAS
from clinic import frame, seed_two_stays


def write_inputs(spark, root, fmt):
    rows = seed_two_stays()
    for name in SOURCE_SCHEMAS:
        writer = frame(spark, name, rows.get(name, [])).write
        writer.option("header", True).format(fmt).save(f"{root}/tables/{name}.{fmt}")
    (root / "ids.csv").write_text("subject_id\n1\n2\n3\n")
    (root / "labs.csv").write_text("itemid,min,max\n50912,0.1,15\n51222,2,25\n")
    (root / "vitals.csv").write_text("itemid,min,max\n211,10,300\n51,20,250\n")
    return {
        "tables": f"{root}/tables",
        "subjects": f"{root}/ids.csv",
        "lab_bounds": f"{root}/labs.csv",
        "vital_bounds": f"{root}/vitals.csv",
        "output": f"{root}/out",
    }


def test_job_from_csv_to_csv(spark, tmp_path):
    paths = write_inputs(spark, tmp_path, "csv")
    report = run_job(spark, **paths, tables_format="csv")
    assert report.row_counts == {"cohort": 2, "labs": 20, "vitals": 36, "targets": 2}
    assert {k: v.count() for k, v in report.samples.items()} == {
        "cohort": 2, "labs": 5, "vitals": 5, "targets": 2,
    }


def test_job_command_line(spark, tmp_path, capsys):
    paths = write_inputs(spark, tmp_path, "parquet")
    flags = [part for k, v in paths.items() for part in (f"--{k.replace('_', '-')}", v)]
    main([*flags, "--output-format", "parquet"])
    printed = capsys.readouterr().out
    assert "vitals: 36 rows" in printed and "excluded:age" in printed
    assert spark.read.parquet(f"{tmp_path}/out/labs").count() == 20


def test_job_puts_the_plan_settings_in_force(spark, tmp_path, capsys):
    """A cluster's session comes without them; item lists must still reach the files whole."""
    from anchorline.session import PLAN_SETTINGS

    paths = write_inputs(spark, tmp_path, "parquet")
    key = "spark.sql.parquet.pushdown.inFilterThreshold"
    spark.conf.set(key, "10")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    main([part for k, v in paths.items() for part in (f"--{k.replace('_', '-')}", v)])
    assert {name: spark.conf.get(name) for name in PLAN_SETTINGS} == PLAN_SETTINGS
    rows = spark.read.parquet(f"{tmp_path}/tables/chartevents.parquet").where(
        f"itemid IN ({', '.join(map(str, range(70)))})"
    )
    assert "In(itemid, [" in rows._jdf.queryExecution().executedPlan().toString()


def test_samples_are_the_first_rows(spark, tmp_path):
    report = run_job(spark, **write_inputs(spark, tmp_path, "parquet"), output_format="parquet")
    labs = spark.read.parquet(f"{tmp_path}/out/labs").collect()
    key = lambda r: (r.subject_id, r.hadm_id, r.charttime, r.itemid, r.valuenum)
    assert report.samples["labs"].collect() == sorted(labs, key=key)[:5]
