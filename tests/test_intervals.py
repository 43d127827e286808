"""Intervals from resampled confusion cells against resampled rows."""

import numpy as np
import pandas as pd
import pytest

from rulelens.operators import metrics as M


def scores(y, s, labels):
    """The metrics of two label vectors, one by one."""
    n, hit = len(y), y == s
    rec = [hit[y == c].mean() if (y == c).any() else 0 for c in labels]
    f1 = [2 * (hit & (y == c)).sum() / ((y == c).sum() + (s == c).sum()) if (y == c).any() or (s == c).any() else None for c in labels]
    chance = sum((y == c).mean() * (s == c).mean() for c in labels)
    return {"accuracy": hit.mean(), "balanced_accuracy": np.mean([r for r, c in zip(rec, labels) if (y == c).any()]), "macro_f1": np.mean([f for f in f1 if f is not None]), "kappa": (hit.mean() - chance) / (1 - chance)}


def test_intervals_equal_those_of_resampled_rows(spark):
    rng = np.random.default_rng(5)
    labels = np.array(["a", "b", "c"])
    y = labels[rng.choice(3, 600, p=[0.6, 0.3, 0.1])]
    s = np.where(rng.random(600) < 0.75, y, labels[rng.choice(3, 600)])
    cells = pd.DataFrame({"truth": y, "pred": s, "g": "x"}).value_counts().reset_index(name="n")
    got = {r["metric"]: r for r in M.confusion_intervals(spark.createDataFrame(cells), ["g"], replicas=4000, more={"rare_recall": lambda t: t[:, 2, 2] / np.maximum(t[:, 2].sum(axis=1), 1)}).collect()}
    draws = [scores(y[i], s[i], labels) for i in (rng.integers(0, 600, 600) for _ in range(4000))]
    for name, value in scores(y, s, labels).items():
        rows = np.array([d[name] for d in draws])
        assert got[name]["value"] == pytest.approx(value) and got[name]["replicas"] == 4000
        assert got[name]["std"] == pytest.approx(rows.std(), rel=0.06)
        for end, q in (("ci_low", 0.025), ("ci_high", 0.975)):
            assert got[name][end] == pytest.approx(np.quantile(rows, q), abs=0.2 * rows.std())
    assert got["rare_recall"]["ci_low"] < got["rare_recall"]["value"] < got["rare_recall"]["ci_high"]


def test_draws_depend_on_key_and_seed_only(spark):
    cells = spark.createDataFrame([(g, t, p, 5 + i) for g in "uvw" for i, (t, p) in enumerate([("a", "a"), ("a", "b"), ("b", "b")])], "g string, truth string, pred string, n long")
    a = sorted(map(tuple, M.confusion_intervals(cells, ["g"], replicas=200).collect()))
    b = sorted(map(tuple, M.confusion_intervals(cells.filter("g <> 'v'").repartition(5), ["g"], replicas=200).collect()))
    assert b == [r for r in a if r[0] != "v"]


def test_tables_without_a_value(spark):
    cells = spark.createDataFrame([("one", "a", "a", 9), ("none", "a", "a", 0), ("null", None, "a", 3)], "g string, truth string, pred string, n long")
    got = {(r["g"], r["metric"]): r for r in M.confusion_intervals(cells, ["g"], replicas=50).collect()}
    assert {g for g, _ in got} == {"one"} and got["one", "accuracy"]["ci_low"] == 1.0 and got["one", "kappa"]["replicas"] == 0


def test_a_huge_table_costs_no_more(spark):
    cells = spark.createDataFrame([("a", "a", 9 * 10**11), ("a", "b", 10**11)], "truth string, pred string, n long")
    r = M.confusion_intervals(cells, metrics=["accuracy"], replicas=300).first()
    assert r["value"] == 0.9 and 0 < r["ci_high"] - r["ci_low"] < 2e-6
