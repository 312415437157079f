import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler

from anchorline import Bounds, extract
from anchorline import fixed_values as fv
from anchorline.plans.scoring import score_subjects
from brute import random_clinic
from clinic import subject_ids, tables


def test_probabilities_per_subject(spark, tmp_path):
    rows = random_clinic(11)
    ids = sorted({a["subject_id"] for a in rows["admissions"]})
    result = extract(
        tables(spark, **rows),
        subject_ids(spark, ids),
        Bounds.from_rows(spark, fv.LAB_BOUNDS),
        Bounds.from_rows(spark, fv.VITAL_BOUNDS),
    )
    labelled = result.cohort.join(result.targets.drop("hadm_id"), "subject_id")
    stages = [VectorAssembler(inputCols=["admission_age", "received_rrt"], outputCol="features")]
    fitted = {}
    for label in ("mortality", "prolonged_los"):
        pipeline = Pipeline(stages=stages + [LogisticRegression(labelCol=label, maxIter=3)])
        # stored and loaded, as a scoring job would find it: a freshly fitted
        # model still holds its training data and with it the session
        pipeline.fit(labelled).write().save(f"{tmp_path}/{label}")
        fitted[label] = PipelineModel.load(f"{tmp_path}/{label}")
    fitted["readmission_30d"] = SQLTransformer(statement="SELECT *, 0.25D AS probability FROM __THIS__")
    scored = score_subjects(result.cohort, fitted)
    assert scored.columns == [
        "subject_id", "mortality_proba", "prolonged_LOS_proba", "readmission_proba",
    ]
    got = scored.collect()
    assert {r.subject_id for r in got} == {r.subject_id for r in result.cohort.collect()}
    for row in got:
        assert 0 <= row.mortality_proba <= 1 and 0 <= row.prolonged_LOS_proba <= 1
        assert row.readmission_proba == pytest.approx(0.25)
