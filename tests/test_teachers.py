"""Calibration is kept where it helps and only there; a search judges every setting out of fold."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from rulelens.operators import teachers as TE

PROBS = {"a": "p_a", "b": "p_b", "c": "p_c"}


def scores(spark, power, n=6000):
    """Labels drawn from known probabilities; the teacher reports them raised to a power."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1.0, 1.2, 0.8], n)
    y = [("a", "b", "c")[rng.choice(3, p=q)] for q in p]
    q = p**power / (p**power).sum(axis=1, keepdims=True)
    return spark.createDataFrame([(y[i], i % 3, *map(float, q[i])) for i in range(n)] + [(None, 0, 0.2, 0.3, 0.5), ("a", 1, None, 0.5, 0.5)], "y string, fold int, p_a double, p_b double, p_c double")


def test_a_teacher_that_is_too_sure_is_calibrated(spark):
    df = scores(spark, 3.0)
    found = TE.calibrate(df, PROBS, "y", "fold", 3)
    assert found.accepted and found.report["ece_after"] < 0.5 * found.report["ece_before"] and found.report["log_loss_after"] < found.report["log_loss_before"]
    out = found.apply(df.dropna(), PROBS)
    assert out.columns == df.columns and out.agg(F.max(F.abs(F.col("p_a") + F.col("p_b") + F.col("p_c") - 1))).first()[0] < 1e-9
    # each map is monotone
    for m in found.maps.values():
        assert (np.diff(m.predictions.toArray()) >= -1e-12).all()


def test_a_right_teacher_stays_as_it_is(spark):
    df = scores(spark, 1.0)
    found = TE.calibrate(df, PROBS, "y", "fold", 3)
    assert not found.accepted and found.report["ece_after"] == found.report["ece_before"] and found.apply(df, PROBS) is df


def test_a_map_that_costs_accuracy_is_refused(spark, monkeypatch):
    """Better probabilities do not pay for worse answers."""
    judged = TE._judged
    seen = []

    def worse(df, probs, truth):
        seen.append(judged(df, probs, truth))
        return seen[-1] if len(seen) == 1 else seen[-1] | {"accuracy": seen[0]["accuracy"] - 0.05}

    monkeypatch.setattr(TE, "_judged", worse)
    assert not TE.calibrate(scores(spark, 3.0, 1500), PROBS, "y", "fold", 3).accepted


def test_search_draws_judges_and_refits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame([(*map(float, x[i]), float(y[i]), i % 3) for i in range(400)], "a double, b double, c double, y double, fold int"))
    found = TE.random_search(rows.select("features", "y", "fold"), "y", "fold", 3, 3, 2, trials=3, families=("linear",))
    table = found.trials.orderBy("trial").collect()
    assert len({r["setting"] for r in table}) == 3 and sum(r["chosen"] for r in table) == 1
    best = max(table, key=lambda r: (round(r["balanced_accuracy"], 12), -r["trial"]))
    assert best["chosen"] and best["balanced_accuracy"] > 0.85
    again = TE.random_search(rows.select("features", "y", "fold"), "y", "fold", 3, 3, 2, trials=3, families=("linear",))
    assert again.setting == found.setting and TE.balanced_accuracy(found.model.transform(rows), "y", "prediction") == pytest.approx(best["balanced_accuracy"], abs=0.05)


def test_maps_come_from_points_counted_once(spark):
    """The map without a fold equals one fitted on the rows outside it, and reads a written table of distinct probabilities."""
    from pyspark.ml.regression import IsotonicRegression
    df = scores(spark, 2.0, 900).dropna().withColumns({c: F.round(c, 2) for c in PROBS.values()})
    points = TE._points(df, PROBS, "y", "fold", 3)
    assert points["a"].count() == df.select("p_a").distinct().count() and points["a"].inputFiles()
    for without, part in ((1, df.filter("fold <> 1")), (None, df)):
        maps = TE._fit_maps(points, without)
        rows = part.groupBy("p_b").agg(F.avg((F.col("y") == "b").cast("double")).alias("hit"), F.count(F.lit(1)).cast("double").alias("n"))
        direct = IsotonicRegression(featuresCol="p_b", labelCol="hit", weightCol="n").fit(rows)
        assert np.allclose(maps["b"].boundaries.toArray(), direct.boundaries.toArray()) and np.allclose(maps["b"].predictions.toArray(), direct.predictions.toArray())
