"""Statistics against hand-computed values and published tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelens.functions import pvalues as PV
from rulelens.operators import statistics as ST


def test_tails_match_tables():
    assert PV.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert PV.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert PV.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert PV.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert PV.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)


def test_signed_rank_exact_matches_enumeration():
    n, w = 7, 5.0
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    tail = sum(s <= w for s in sums) / len(sums)
    assert PV.signed_rank_exact(w, n) == pytest.approx(min(1.0, 2 * tail))


def test_holm_and_benjamini_hochberg_keep_missing(spark):
    p = [0.01, 0.04, 0.03, None, 0.005]
    df = spark.createDataFrame([(i, "f", x) for i, x in enumerate(p)], "i int, fam string, p double")
    holm = {r["i"]: r["p_holm"] for r in ST.holm(df, "p", ["fam"], ["i"]).collect()}
    bh = {r["i"]: r["p_bh"] for r in ST.benjamini_hochberg(df, "p", ["fam"], ["i"]).collect()}
    assert holm[3] is None and bh[3] is None
    assert [holm[i] for i in (4, 0, 2, 1)] == pytest.approx([0.02, 0.03, 0.06, 0.06])
    assert [bh[i] for i in (4, 0, 2, 1)] == pytest.approx([0.02, 0.02, 0.04, 0.04])


def frame(spark, a, b):
    rows = [("d", i, m, "t", arm, 100, v) for arm, vs in (("x", a), ("y", b)) for i, v in enumerate(vs) for m in ["accuracy"]]
    return spark.createDataFrame(rows, "dataset string, split_id int, metric string, oracle_name string, arm string, n_test int, value double")


def test_paired_summary_and_ranks(spark):
    a, b = [0.9, 0.8, 0.7, 0.6, 0.5], [0.8, 0.8, 0.75, 0.4, 0.2]
    paired = ST.pairs(frame(spark, a, b), [dict(name="c", a="x", b="y")])
    s = ST.paired_summary(paired, ["dataset", "contrast", "metric"]).first()
    d = [0.1, 0.0, -0.05, 0.2, 0.3]
    assert (s["wins_a"], s["wins_b"], s["ties"], s["n_pairs"]) == (3, 1, 1, 5)
    assert s["mean_diff"] == pytest.approx(sum(d) / 5)
    assert s["sign_p"] == pytest.approx(2 * (1 + 4) / 2 ** 4)
    r = ST.signed_ranks(paired, ["dataset", "contrast", "metric"]).first()
    assert (r["w_plus"], r["w_minus"]) == (9.0, 1.0)
    assert r["rank_biserial"] == pytest.approx(0.8)
    c = ST.cliffs_delta(paired, ["dataset"]).first()["cliffs_delta"]
    assert c == pytest.approx(sum((x > y) - (x < y) for x in a for y in b) / 25)


def test_identical_arms_give_no_evidence(spark):
    paired = ST.pairs(frame(spark, [0.5] * 4, [0.5] * 4), [dict(name="c", a="x", b="y")])
    s = ST.t_interval(ST.paired_summary(paired, ["dataset"])).withColumn("rank_biserial", F.lit(0.0))
    assert ST.evidence(s, "sign_p", "rank_biserial").first()["evidence"] == "IDENTICAL_RESULTS"


def test_joint_verdict_truth_table(spark):
    """All order patterns of three arms on two measures follow the declared precedence."""
    levels = (0.1, 0.2, 0.3)
    rows = [(*acc, *fid) for acc in itertools.product(levels, repeat=3) for fid in itertools.product(levels, repeat=3)]
    names = ["ar", "ao", "ac", "fr", "fo", "fc"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    got = df.withColumn("v", ST.joint_verdict(*[F.col(n) for n in names])).collect()
    assert len(got) == 729
    for r in got:
        ar, ao, ac, fr, fo, fc = (r[n] for n in names)
        if ar > ao > ac and fr > fo and fr > fc:
            want = "JOINT_HIERARCHY_SATISFIED"
        elif not ao > ac:
            want = "HIERARCHY_INFEASIBLE"
        elif (ar > ao and fr < fo) or (fr > fo and ar < ao) or (ar > ac and fr < fc) or (fr > fc and ar < ac):
            want = "TRADEOFF"
        else:
            want = "NOT_SATISFIED"
        assert r["v"] == want


def test_friedman_matches_formula(spark):
    m = [[0.9, 0.8, 0.7], [0.8, 0.85, 0.6], [0.95, 0.7, 0.6], [0.7, 0.65, 0.6]]
    rows = [("m", i, f"a{j}", v) for i, r in enumerate(m) for j, v in enumerate(r)]
    got = ST.friedman(spark.createDataFrame(rows, "metric string, block int, arm string, value double"), ["metric"], ["block"]).first()
    ranks = [[sorted(r, reverse=True).index(v) + 1 for v in r] for r in m]
    sums = [sum(r[j] for r in ranks) for j in range(3)]
    assert got["chi2"] == pytest.approx(12 / (4 * 3 * 4) * sum(s * s for s in sums) - 3 * 4 * 4)


def test_pareto_front_matches_brute_force(spark):
    rows = [(i, float((i * 37) % 11), float((i * 53) % 13), float((i * 29) % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double").repartition(5)
    got = {r["k"] for r in ST.pareto_front(df, "k", ["a", "b", "c"]).collect()}
    beats = lambda x, y: all(p >= q for p, q in zip(x[1:], y[1:])) and any(p > q for p, q in zip(x[1:], y[1:]))
    assert got == {r[0] for r in rows if not any(beats(o, r) for o in rows)}


def plain_front(v, eps=1e-12):
    return {i for i in range(len(v)) if not ((v >= v[i] - eps).all(axis=1) & (v > v[i] + eps).any(axis=1)).any()}


@pytest.mark.parametrize("kind", ["ties", "smooth", "one_metric", "hot", "near_eps"])
def test_pareto_front_by_grid(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    v = {"ties": lambda: rng.integers(0, 6, (700, 3)).astype(float), "smooth": lambda: rng.normal(size=(900, 3)), "one_metric": lambda: rng.integers(0, 9, (300, 1)).astype(float),
         "hot": lambda: np.concatenate([np.full((400, 2), 0.7), rng.random((400, 2))]), "near_eps": lambda: rng.integers(0, 40, (600, 2)) + rng.choice([-4e-13, 0, 4e-13], (600, 2))}[kind]()
    for name, value in (("BLOCK_ROWS", 60), ("RIVAL_ROWS", 90), ("GRID_CELLS", 64)):
        monkeypatch.setattr(ST, name, value)
    metrics = [f"m{j}" for j in range(v.shape[1])]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], ["k", *metrics]).repartition(5)
    assert {r["k"] for r in ST.pareto_front(df, "k", metrics).collect()} == plain_front(v)


def test_pareto_front_of_many_rows_and_of_none(spark):
    """All 200,000 rows lie on a curve where none beats another; 1,000 below it are beaten; two without a metric stay."""
    x = F.col("id") / 200_000
    curve = spark.range(200_000).select("id", x.alias("a"), (1 - x * x).alias("b"))
    below = spark.range(1000).select((F.col("id") + 1_000_000).alias("id"), (F.col("id") / 1000 * 0.9).alias("a"), (0.9 - (F.col("id") / 1000) ** 2 * 0.9).alias("b"))
    gaps = spark.createDataFrame([(-1, None, 5.0), (-2, float("nan"), 0.0)], "id long, a double, b double")
    front = ST.pareto_front(curve.unionByName(below).unionByName(gaps), "id", ["a", "b"])
    assert front.agg(F.count("*"), F.sum("id")).first() == (200_002, 200_000 * 199_999 // 2 - 3)
    assert ST.pareto_front(curve.limit(0), "id", ["a", "b"]).count() == 0


def test_mcnemar_exact(spark):
    rows = [("a", "a", "b")] * 8 + [("a", "b", "a")] * 2 + [("a", "a", "a")] * 5
    r = ST.mcnemar(spark.createDataFrame(rows, "y string, p string, q string"), "y", "p", "q").first()
    assert (r["b"], r["c"]) == (8, 2)
    assert r["exact_p"] == pytest.approx(2 * sum(math.comb(10, k) for k in range(3)) / 2 ** 10)


def test_ranks_come_without_regrouping_the_rows(spark):
    """Mid-ranks of every column beside each other, nulls kept; no aggregate holds a group for each row."""
    from rulelens.operators.prep import rank_columns
    rows = [(i, float(i % 4), None if i % 5 == 0 else float(-i)) for i in range(20)]
    found = rank_columns(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"])

    def mid(values, v):
        return None if v is None else sum(u < v for u in values) + (sum(u == v for u in values) + 1) / 2

    known = [b for _, _, b in rows if b is not None]
    assert {r["id"]: (r["a"], r["b"]) for r in found.collect()} == {i: (mid([a for _, a, _ in rows], a), mid(known, b)) for i, a, b in rows}
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
