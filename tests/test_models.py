import math
import random

import pytest
from pyspark.sql import functions as F

from pitchspark.operators import models


def table(spark, n=400, seed=1):
    """Goals that depend on a feature; another one is noise and often missing."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = rng.uniform(-1, 1)
        goals = sum(rng.random() < min(1, max(0, 0.25 + 0.2 * x)) for _ in range(6))
        rows.append((str(i), min(goals, 2), goals, i, x, rng.random() if rng.random() < 0.7 else None, None))
    return spark.createDataFrame(rows, "row_id string, actual int, goals int, t int, x double, noise double, never double")


FEATURES = ["x", "noise", "never"]


@pytest.mark.parametrize(("family", "target"), [("LOGISTIC", "MULTICLASS"), ("POISSON", "COUNT"), ("RANDOMFOREST", "MULTICLASS"), ("GRADIENTBOOSTING", "BINARY_P1")])
def test_families_give_distributions(spark, family, target):
    rows = models.with_indicators(table(spark, 200), FEATURES)
    small = {"n_estimators": 5, "max_depth": 3} if family == "RANDOMFOREST" else {"max_iter": 5} if family == "GRADIENTBOOSTING" else {}
    model, _, share = models.fit(rows, FEATURES, family, target, **small)
    found = models.predict(model, rows, target, share).collect()
    assert len(found) == 200 and all(abs(r["p0"] + r["p1"] + r["p2"] - 1) < 1e-9 and min(r["p0"], r["p1"], r["p2"]) > 0 for r in found)


def test_unknown_families_and_one_class_are_errors(spark):
    with pytest.raises(models.DependencyMissing):
        models.pipeline("CATBOOST", "MULTICLASS", FEATURES)
    with pytest.raises(models.InsufficientData):
        models.fit(models.with_indicators(table(spark, 50).withColumn("actual", F.lit(1)), FEATURES), FEATURES, "LOGISTIC", "MULTICLASS")


def test_walk_forward_never_looks_ahead(spark):
    rows = table(spark)
    marked, folds = models.split(models.with_indicators(rows, FEATURES), ["t", "row_id"])
    assert folds == [(128, 192), (192, 256), (256, 320)] and marked.where("locked").count() == 80 and marked.where("locked").agg(F.min("t")).first()[0] == 320
    found = models.experiment(rows, FEATURES, ["t", "row_id"], "LOGISTIC", calibration="SIGMOID").collect()
    places = {r["row_id"]: r["fold"] for r in found}
    assert {int(i) for i in places} == set(range(128, 320)) and all(places[str(i)] == 1 + (i - 128) // 64 for i in range(128, 320))
    actual = {r["row_id"]: r["actual"] for r in rows.collect()}
    loss = -sum(math.log(r[f"p{actual[r['row_id']]}"]) for r in found) / len(found)
    counts = [sum(actual[str(i)] == k for i in range(128)) / 128 for k in range(3)]
    prior = -sum(math.log(counts[actual[r["row_id"]]]) for r in found) / len(found)
    assert loss < prior  # the feature helps on rows that weren't seen
    assert any(abs(r["p1"] - r["raw1"]) > 1e-6 for r in found)


@pytest.mark.parametrize("method", ["SIGMOID", "ISOTONIC"])
def test_calibration_mends_a_bias(spark, method):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        p = rng.uniform(0.1, 0.6)
        y = 1 if rng.random() < p / 2 else rng.choice([0, 2])
        rows.append((str(i), y, (1 - p) / 2, p, (1 - p) / 2))
    df = spark.createDataFrame(rows, "row_id string, actual int, p0 double, p1 double, p2 double")
    found = models.calibrated(df, models.calibrators(df, method), method).agg(F.avg("p1"), F.max(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1))).first()
    rate = sum(r[1] == 1 for r in rows) / 600
    assert abs(found[0] - rate) < 0.03 and found[1] < 1e-9 and abs(sum(r[3] for r in rows) / 600 - rate) > 0.1
    assert models.calibrators(df.limit(10), method) is None


def test_predictions_of_an_experiment_are_replaced_alone(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "row_id string, actual int")
    for name, rows in (("e1", df), ("e2", df), ("e1", df.limit(0).union(df))):
        models.save_predictions(rows, str(tmp_path / "p"), name)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
