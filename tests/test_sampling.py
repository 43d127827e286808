"""Query selection against a plain greedy search over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelens.functions.ordering import running_sums
from rulelens.operators import sampling as SM
from rulelens.plans.sampling import weights_by_kind


def greedy(x, score, k, weight=0.5):
    chosen = [int(np.lexsort((np.arange(len(score)), -score))[0])]
    while len(chosen) < min(k, len(x)):
        d = np.sqrt(((x[:, None, :] - x[chosen][None, :, :]) ** 2).sum(axis=2)).min(axis=1)
        value = score + weight * d / (np.delete(d, chosen).max() + 1e-12)
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
    return chosen


def test_diverse_rows_are_chosen_from_all_rows(spark):
    rng = np.random.default_rng(1)
    x, score = rng.normal(size=(700, 2)), np.round(-rng.random(700), 9)
    x[:300], score[:300] = 0.0, -0.001  # many copies of one point at the margin
    df = spark.createDataFrame([(i, float(a), float(b), float(s)) for i, ((a, b), s) in enumerate(zip(x, score))], "id long, a double, b double, s double")
    got = SM.diverse_top(df, "id", F.col("s"), ["a", "b"], {"a": 1.0, "b": 1.0}, 12).orderBy("place").collect()
    assert [r["id"] for r in got] == greedy(x, score, 12)
    assert [r["score"] for r in got] == pytest.approx([score[r["id"]] for r in got])
    few = df.limit(3)
    assert SM.diverse_top(few, "id", F.col("s"), ["a", "b"], {"a": 1.0, "b": 1.0}, 12).count() == 3
    assert SM.diverse_top(df.filter("id < 0"), "id", F.col("s"), ["a", "b"], {"a": 1.0, "b": 1.0}, 12).count() == 0


def test_a_rare_region_is_an_error_with_numbers(spark):
    draw = lambda n, r: spark.range(n).select(F.col("id").alias("draw"), (F.col("id") + 1000 * r).alias("x"))
    with pytest.raises(SM.Shortfall, match="0 of 20 draws passed"):
        SM.draw_until(draw, F.col("x") < 0, 20, rounds=4)
    some, tried = SM.draw_until(draw, F.col("x") < 7, 20, rounds=3, partial=True)
    assert some.count() == 7 and tried > 120
    full, _ = SM.draw_until(draw, F.col("x") % 2 == 0, 20)
    assert [r["draw"] for r in full.orderBy("draw").collect()] == list(range(0, 40, 2))  # the first ones, whatever the partitions


def test_local_trees_hold_the_instances_candidates(spark):
    from rulelens.operators import counterfactual as CF

    rows = spark.createDataFrame([(i, float(i), "n" if i < 50 else "p") for i in range(60)], "id long, x double, cls string")
    made = spark.createDataFrame([(3, 200.0 + i, "p") for i in range(10)], "instance long, x double, cls string")
    got = {r["instance"]: r for r in CF.local_trees(rows.filter("id IN (3, 52)"), rows, "id", ["x"], "cls", ["n", "p"], {"x": 1.0}, size=20, candidates=made).collect()}
    # thresholds are deciles, so the cut lies inside the candidates and one of them shares a leaf with observed rows
    assert (got[3]["rows"], got[3]["candidates"], got[3]["observed_fidelity"]) == (20, 10, 1.0) and got[3]["local_fidelity"] == pytest.approx(29 / 30)
    assert (got[52]["rows"], got[52]["candidates"]) == (20, 0)


def test_teachers_read_written_cases(tables):
    """Fits read their rows many times: those are a table, not the ranking of all orders once more."""
    from rulelens.plans.sampling import ml_cases
    cases = ml_cases(tables)
    assert cases.inputFiles() and not any("orders.parquet" in f for f in cases.inputFiles())
    assert cases.groupBy("id").count().filter("count > 1").count() == 0 and cases.count() == tables.orders.count()


def test_forests_read_written_sides(spark, monkeypatch):
    """Draws and real rows are a table before the first forest is fitted, with every real row in it."""
    from rulelens.plans import sampling as P
    from rulelens.plans.registry import QUERIES
    seen, inner = [], P.SM.out_of_fold

    def held(df, *args):
        seen.append(([f for f in df.inputFiles() if "lineitem" in f], df.filter("label = 0").count(), df.filter("label = 1").count()))
        return inner(df, *args)

    monkeypatch.setattr(P.SM, "out_of_fold", held)
    QUERIES["sm11_real_synthetic_gap"](spark, "/root/testdata/sf0.001").collect()
    assert seen == [([], spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count(), P.N_DRAWS)]


@pytest.mark.parametrize("copies, factor", [(0, 2.0), (9000, 1.6), (9000, 1.9), (0, 3.9), (9000, 0.5)])
def test_heaviest_soft_targets_are_found_by_counts_that_do_not_grow(spark, monkeypatch, copies, factor):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([1.0, 1.0, 1.0], 20_000)
    p[:copies] = [0.5, 0.3, 0.2]  # ties at the cap
    df = spark.createDataFrame([(i, "a", *map(float, r)) for i, r in enumerate(p)], "id long, y string, a double, b double, c double")
    ordered = []
    monkeypatch.setattr(SM, "running_sums", lambda counts, *a, **k: ordered.append(counts.count()) or running_sums(counts, *a, **k))
    got = SM.soft_targets(df, ["id"], "y", {"a": "a", "b": "b", "c": "c"}, max_factor=factor).filter("kind = 'soft'").toPandas()
    s = np.sqrt(np.maximum(p, 1e-12))
    s /= s.sum(axis=1, keepdims=True)
    lift = 1 + 0.5 * -(s * np.log(s)).sum(axis=1, keepdims=True) / np.log(3)
    masses = np.sort((s * lift)[s >= 0.03])[::-1]
    room = max(0, int(20_000 * (factor - 1)))
    assert len(got) == min(room, len(masses)) and not got.duplicated(["id", "label"]).any()
    assert np.sort(got["weight"].to_numpy())[::-1] / 0.35 == pytest.approx(masses[:room], abs=2e-9)
    assert max(ordered) <= 15_001  # cells of masses, however many masses there are


def test_soft_targets_are_not_ordered_where_all_fit(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 0.5, 0.3, 0.2), (2, "b", 1.0, 0.0, 0.0), (3, None, None, 0.6, 0.4)], "id long, y string, a double, b double, c double")
    monkeypatch.setattr(SM, "running_sums", lambda *a, **k: pytest.fail("masses were put in order"))
    got = SM.soft_targets(df, ["id"], "y", {"a": "a", "b": "b", "c": "c"}, max_factor=4.0)
    assert {(r["id"], r["label"]) for r in got.filter("kind = 'soft'").collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "b"), (3, "c")}
    assert got.filter("kind = 'hard'").count() == 3


def test_weights_of_many_rows_add_up(spark):
    rows = spark.range(0, 30_000_000, 1, 4).select(F.lit("hard").alias("kind"), F.xxhash64("id").alias("rid"), F.lit(0.65).alias("weight"))
    got = weights_by_kind(rows).collect()
    assert [(r["kind"], r["n"]) for r in got] == [("hard", 30_000_000)]
    assert got[0]["weight"] == pytest.approx(19500.0, rel=0, abs=1e-8)  # one sum a task is off by more than 1e-7
