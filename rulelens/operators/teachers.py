"""Teachers fitted with spark.ml: random search over settings, and probabilities calibrated only where that helps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Row, functions as F

from rulelens.functions.lineage import written
from rulelens.functions.shapes import add, hits, share, unions
from rulelens.operators.metrics import calibration_error, log_loss_and_brier
from rulelens.operators.sampling import out_of_fold

MIN_GAIN = 0.01  # share by which the log-loss must fall for a calibration to be kept


def settings(features: int, classes: int) -> dict[str, tuple[Callable, list[dict]]]:
    """The settings that a search draws from: layers and rates of perceptrons, penalties and their mix of linear models."""
    layers = [[features, *h, classes] for h in ([6], [16], [16, 8])]
    nets = [dict(layers=h, stepSize=s, maxIter=m) for h, s, m in product(layers, (0.03, 0.1), (30, 60))]
    lines = [dict(regParam=r, elasticNetParam=e, maxIter=30) for r, e in product((0.0, 0.001, 0.01, 0.1), (0.0, 0.5))]
    return {"perceptron": (MultilayerPerceptronClassifier, nets), "linear": (LogisticRegression, lines)}


@dataclass
class Search:
    trials: DataFrame  # trial, family, setting, balanced_accuracy, log_loss, chosen
    family: str
    setting: dict
    model: object  # fitted on all rows


def balanced_accuracy(df: DataFrame, truth: str, guess: str) -> float | None:
    """Mean of the recalls of the classes that occur; classes are few."""
    return df.groupBy(truth).agg(share(F.col(truth) == F.col(guess)).alias("r")).agg(F.avg("r")).first()[0]


def random_search(df: DataFrame, label: str, fold: str, k: int, features: int, classes: int, trials: int = 6, seed: int = 7, families: Sequence[str] = ("perceptron", "linear")) -> Search:
    """The best of ``trials`` settings drawn without repetition, by balanced accuracy out of fold, fitted on all rows.

    Every setting is judged on the same folds, none sees the row that it is judged on; ties go to the setting drawn first. Rows
    outside ``df`` (a test) have no part in it.
    """
    space = [(f, make, s) for f, (make, every) in settings(features, classes).items() if f in families for s in every]
    picked = [space[i] for i in np.random.default_rng(seed).permutation(len(space))[:trials]]
    rows = written(df, "search")  # every trial reads the rows many times
    results = []
    for n, (family, make, setting) in enumerate(picked):
        held = out_of_fold(rows, make(labelCol=label, **({"seed": seed} if family == "perceptron" else {}), **setting), fold, k)
        results.append(Row(trial=n, family=family, setting=", ".join(f"{a}={b}" for a, b in sorted(setting.items())), balanced_accuracy=balanced_accuracy(held, label, "prediction")))
    best = max(range(len(picked)), key=lambda i: (round(results[i]["balanced_accuracy"] or 0.0, 12), -i))
    family, make, setting = picked[best]
    model = make(labelCol=label, **({"seed": seed} if family == "perceptron" else {}), **setting).fit(rows)
    table = df.sparkSession.createDataFrame(results, "trial int, family string, setting string, balanced_accuracy double")
    return Search(table.withColumn("chosen", F.col("trial") == best), family, setting, model)


@dataclass
class Calibration:
    """A monotone map for each class's probability; ``accepted`` tells whether it is to be used at all."""

    maps: dict[str, object]
    accepted: bool
    report: dict[str, float]

    def apply(self, df: DataFrame, probs: Mapping[str, str]) -> DataFrame:
        """``df`` with calibrated probabilities, or as it was if the calibration was not accepted."""
        return _mapped(df, probs, self.maps) if self.accepted else df


def _mapped(df: DataFrame, probs: Mapping[str, str], maps: Mapping[str, object]) -> DataFrame:
    """Each probability through its class's map, then divided by their sum; rows that no class is left for stay as they are."""
    kept = df.columns
    for label, c in probs.items():
        df = maps[label].setFeaturesCol(c).setPredictionCol(f"__cal_{label}").transform(df)
    total = add([F.col(f"__cal_{label}") for label in probs])
    new = {c: F.when(total > 0, F.col(f"__cal_{label}") / total).otherwise(F.col(c)) for label, c in probs.items()}
    return df.withColumns(new).select(*kept)


def _points(df: DataFrame, probs: Mapping[str, str], truth: str, fold: str, k: int) -> dict[str, DataFrame]:
    """The distinct probabilities of each class with rows and hits, of all, of those in a fold and of each fold; every map is fitted from these."""
    parts = {"all": F.lit(True), "in": F.col(fold).isNotNull(), **{str(i): F.col(fold) == i for i in range(k)}}
    return {label: written(df.groupBy(F.col(c).alias("p")).agg(*[a.alias(n) for part, here in parts.items() for n, a in ((f"n_{part}", hits(here)), (f"h_{part}", hits(here & (F.col(truth) == label))))]), "points")
            for label, c in probs.items()}


def _fit_maps(points: Mapping[str, DataFrame], without: int | None = None) -> dict[str, object]:
    """Pool-adjacent-violators on the counted distinct probabilities of each class, of all rows or of those outside a fold."""
    n, h = (F.col(f"{c}_all") if without is None else F.col(f"{c}_in") - F.col(f"{c}_{without}") for c in "nh")
    counted = {label: each.filter(n > 0).select("p", (h / n).alias("hit"), n.cast("double").alias("n")) for label, each in points.items()}
    return {label: IsotonicRegression(featuresCol="p", labelCol="hit", weightCol="n").fit(each) for label, each in counted.items()}


def _judged(df: DataFrame, probs: Mapping[str, str], truth: str) -> dict[str, float]:
    best = F.greatest(*[F.col(c) for c in probs.values()])
    guess = F.coalesce(*[F.when(F.col(c) == best, F.lit(label)) for label, c in probs.items()])  # ties: first in class order
    rows = df.withColumns({"__guess": guess, "__best": best})
    losses = log_loss_and_brier(rows, truth, dict(probs)).first()
    ece = calibration_error(rows, F.col("__guess") == F.col(truth), F.col("__best")).first()["ece"]
    return {"accuracy": rows.agg(share(F.col("__guess") == F.col(truth))).first()[0], "balanced_accuracy": balanced_accuracy(rows, truth, "__guess"),
            "log_loss": losses["log_loss"], "brier": losses["brier_multiclass"], "ece": ece}


def calibrate(scores: DataFrame, probs: Mapping[str, str], truth: str, fold: str, k: int, min_gain: float = MIN_GAIN) -> Calibration:
    """Maps fitted on out-of-fold probabilities, kept only if the main scores do not fall.

    ``scores`` holds probabilities by models that did not see the row. To judge the maps, each fold's rows go through maps fitted
    on the other folds. They are accepted if accuracy and balanced accuracy are not lower by more than one standard error of the
    accuracy (maps of single classes may swap answers that are almost level), the Brier score is lower and the log-loss is lower
    by the share ``min_gain``; the maps that are used then come from all rows. Rows with a missing probability
    or class take no part.
    """
    rows = scores.dropna(subset=[truth, *probs.values()]).select(truth, fold, *probs.values())
    rows = written(rows, "scores")
    points = _points(rows, probs, truth, fold, k)
    crossed = written(unions([_mapped(rows.filter(F.col(fold) == i), probs, _fit_maps(points, i)) for i in range(k)]), "crossed")
    before, after = _judged(rows, probs, truth), _judged(crossed, probs, truth)
    slack = (before["accuracy"] * (1 - before["accuracy"]) / max(rows.count(), 1)) ** 0.5
    better = all(after[m] >= before[m] - slack for m in ("accuracy", "balanced_accuracy")) and after["brier"] < before["brier"] and after["log_loss"] < before["log_loss"] * (1 - min_gain)
    report = {f"{m}_{side}": v for side, found in (("before", before), ("after", after if better else before)) for m, v in found.items()}
    return Calibration(_fit_maps(points) if better else {}, better, report)
