"""Classifiers on separable rows: held-out accuracy, stored models, forgery types, importances."""

import random

import pytest
from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.operators import learn
from papertrail.plans import evaluation_queries, report_queries


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(120):
        kind = ("none", "whiteout", "copy_move")[i % 3]
        ela, moved = {"none": (.1, .1), "whiteout": (.9, .1), "copy_move": (.5, .9)}[kind]
        out.append((f"A-{i // 2:03d}_{kind}", "genuine" if kind == "none" else "forged", kind, 80.0, ela + rng.random() / 20, moved + rng.random() / 20,
                    rng.random(), rng.random()))
    return spark.createDataFrame(out, "sample_id string, label string, forgery_type string, " + ", ".join(f"{c} double" for c in C.FEATURES)).cache()


def test_models_are_stored_and_separate_the_classes(spark, rows, tmp_path):
    binary = learn.calibrate_forest(rows, folds=2, trees=5)
    types = learn.train_forest(rows.filter("label = 'forged'").withColumn("label", rows.forgery_type), trees=5)
    learn.save_models(binary, types, str(tmp_path / "m"))
    stored = learn.load_models(str(tmp_path / "m"), folds=2)
    kept = rows.select("sample_id", "label", "forgery_type", *C.FEATURES)
    before, after = (sorted(map(str, learn.predict(kept, *models).collect())) for models in ((binary, types), stored))
    assert before == after
    judged = learn.predict(kept, *stored).join(rows.select("sample_id", "forgery_type", rows.label.alias("truth")), "sample_id").collect()
    assert sum(r["predicted"] == r["truth"] for r in judged) >= 118
    assert all((r["forgery_type_predicted"] is None) == (r["predicted"] == "genuine") for r in judged)
    assert learn.load_models(str(tmp_path / "m"), folds=2, with_types=False)[1] is None


def test_importances_name_the_features_that_matter(spark, rows):
    found = {r["feature"]: r["importance"] for r in learn.importance_rows(spark, learn.calibrate_forest(rows, folds=2, trees=5)).collect()}
    assert set(found) == set(C.FEATURES) and sum(found.values()) == pytest.approx(1)
    assert found["ela_score"] + found["copy_move_score"] > .8


def test_features_are_computed_once(spark, rows, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(value):
        seen.add(1)
        return value
    monkeypatch.setattr(evaluation_queries, "features", lambda t: rows.withColumn("ela_score", F.udf(counted, "double")("ela_score")))
    _, split = report_queries._trained(None)
    assert split.count() == 120 and seen.value == 120
