"""Generated candidates must hold on the model and on every hard constraint; searches are compared with brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelens.functions import neighbours as N
from rulelens.operators import counterfactual as CF
from rulelens.operators import ontology as ON
from rulelens.operators import sampling as SM
from rulelens.plans import counterfactual as plan
from rulelens.plans.bases import CASE_CLASSES, CASE_FEATURES, case_teacher, judged


@pytest.fixture(scope="module")
def specs(tables):
    return plan.specs(tables)


def check(df, specs):
    bad = df.filter("valid").filter((case_teacher() != F.col("target")) | (CF.hard_count(specs) > 0))
    assert bad.count() == 0


def test_repair_leaves_nothing_to_report(tables, specs):
    assert CF.violations(plan.fixed(tables), ["id", "candidate"], specs).count() == 0
    assert CF.violations(plan.variants(tables), ["id", "candidate"], specs).count() > 0


def test_rule_candidates_are_valid(tables, specs):
    tasks = plan.chosen(tables, 0.05)
    out = CF.rule_candidates(tasks, plan.RULES, specs, case_teacher)
    check(out, specs)
    assert out.filter("valid AND path_respected").count() > 0


def test_donor_search_is_valid_and_reproducible(tables, specs):
    pool = CF.donor_pool(judged(tables), "id", "cls", CASE_FEATURES, 3)
    run = lambda tasks: CF.donor_search(tasks, pool, specs, case_teacher, plan.target_margin, population=12, elite=4, generations=2)
    a = run(plan.chosen(tables, 0.02))
    check(a, specs)
    b = run(plan.chosen(tables, 0.02).repartition(3))
    cols = ["task", "member", *CASE_FEATURES]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0


def test_linear_candidates_are_valid(tables, specs):
    check(CF.linear_candidates(plan.chosen(tables, 0.05), plan.near(tables), specs, case_teacher, plan.target_probability), specs)


def test_sparsify_keeps_the_class_and_never_adds_changes(tables, specs):
    rows = plan.fixed(tables).withColumn("target", case_teacher()).filter("target <> cls")
    before = CF.changed_units(rows, specs).select("id", "candidate", F.col("n_changed").alias("n0"))
    after = CF.changed_units(CF.sparsify(rows, specs, case_teacher), specs)
    assert after.filter(case_teacher() != F.col("target")).count() == 0
    assert after.join(before, ["id", "candidate"]).filter("n_changed > n0").count() == 0


def test_boundary_points_lie_on_the_boundary(tables):
    rows = judged(tables)
    scales = rows.agg(*[F.stddev_pop(f).alias(f) for f in CASE_FEATURES]).first().asDict()
    got = SM.boundary_points(rows, "id", CASE_FEATURES, "cls", case_teacher, scales, 40)
    assert got.filter(case_teacher() == F.col("cls")).count() == 0


def test_nearest_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(5)
    queries = df.filter("id < 15").withColumnRenamed("id", "q")
    for limit in (4096, 8):
        monkeypatch.setattr(N, "CELL_ROWS", limit)
        got = {(r["q"], r["rank"]): r["neighbour"] for r in N.nearest(df, queries, ["a", "b", "c"], 4, "id", "q").collect()}
        for q in range(15):
            order = np.argsort(np.linalg.norm(x - x[q], axis=1), kind="stable")[:4]
            assert [got[(q, k + 1)] for k in range(4)] == list(order)


def test_density_matches_direct_computation(tables, specs):
    ref = N.reference_block(judged(tables), "id", CASE_FEATURES, limit=50)
    rows = judged(tables).filter("id < 20")
    got = {r["id"]: r["knn_distance"] for r in CF.density(rows, ref, "id", specs).collect()}
    span = np.array([specs[f]["span"] for f in CASE_FEATURES])
    r = ref[CASE_FEATURES].to_numpy() / span
    for row in rows.collect():
        d = np.abs(np.array([row[f] for f in CASE_FEATURES]) / span - r).mean(axis=1)
        d = d[ref["id"].to_numpy() != row["id"]]
        assert got[row["id"]] == pytest.approx(np.sort(d)[:5].mean())


def test_draws_respect_the_region_and_do_not_depend_on_partitions(tables):
    from rulelens.plans.bases import FEATURES, SURROGATE, scored
    from rulelens.plans.sampling import LKEY
    rows = scored(tables)
    model = SM.column_model(rows, FEATURES)
    one = SM.marginal_draws(rows, LKEY, FEATURES, 200, 9, model)
    two = SM.marginal_draws(rows.repartition(6), LKEY, FEATURES, 200, 9, model)
    assert one.exceptAll(two).count() == 0 and one.count() == 200
    got, tried = SM.draw_until(lambda n, r: SM.marginal_draws(rows, LKEY, FEATURES, n, r, model), SURROGATE.accepts(4), 50)
    assert got.count() == 50 and tried >= 50
    assert got.filter(~SURROGATE.accepts(4)).count() == 0


def test_closure_merges_equivalents_and_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "subsumption"), ("b", "c", "subsumption"), ("b", "b2", "equivalent"), ("b2", "d", "subsumption"), ("d", "a", "subsumption")], "src string, dst string, relation string")
    got = {(r["node"], r["ancestor"]) for r in ON.closure(edges).collect()}
    assert {("a", "b"), ("a", "b2"), ("a", "c"), ("a", "d"), ("d", "a"), ("b", "b2")} <= got
    assert ("c", "a") not in got


def test_match_blocking_loses_no_candidate(spark):
    """Every pair scoring at least the tracked limit shares a letter pair or a token."""
    names = ["mean radius", "radius_mean", "MeanRadius", "area", "areas", "x", "texture worst", "worst-texture", "smoothness", "smothness", "id"]
    f = spark.createDataFrame([(n,) for n in names], "feature string")
    e = spark.createDataFrame([(n, "class", n) for n in names], "name string, kind string, label string")
    got = {(r["feature"], r["entity"]) for r in ON.match_candidates(f, e).collect()}
    a = f.select("feature", ON.normalised(F.col("feature")).alias("a"), ON.tokens(F.col("feature")).alias("ta"))
    b = a.select(F.col("feature").alias("entity"), F.col("a").alias("b"), F.col("ta").alias("tb"))
    full = a.crossJoin(b).filter(F.round(ON.name_score(F.col("a"), F.col("b"), F.col("ta"), F.col("tb")), 9) >= ON.TRACKED)
    assert got == {(r["feature"], r["entity"]) for r in full.collect()}


def test_walks_follow_chains_of_any_length(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}", "subsumption") for i in range(100)]
    edges = spark.createDataFrame(chain, "src string, dst string, relation string")
    assert {r["component"] for r in ON.components(edges).collect()} == {"n000"}
    assert {r["node"]: r["longest"] for r in ON.taxonomy_depth(edges).collect()} == {f"n{i:03d}": 100 - i for i in range(101)}
    assert ON.closure(edges).count() == 101 * 100 // 2
    with pytest.raises(ValueError):
        ON.taxonomy_depth(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))


def test_draws_stay_beside_their_donors(tables, specs, monkeypatch):
    """Rows of draws are ranked where they are made: only tasks and blocks of donors are moved."""
    monkeypatch.setattr(CF, "DONORS", 16)
    monkeypatch.setattr(CF, "BESIDE", 20)
    near = plan.near(tables)
    assert "hashpartitioning(task" not in near._jdf.queryExecution().executedPlan().toString()
    per = near.groupBy("task", "same").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last")).collect()
    assert {r["task"] for r in per} == {r["task"] for r in plan.chosen(tables).select("task").collect()}
    assert all(r["n"] == r["last"] <= 15 for r in per)


def test_directions_of_a_row_stay_together(tables, specs):
    """No row is made for each direction, and the end lies just beyond a point where the class changes."""
    found = CF.boundary_distance(judged(tables).select("id", *CASE_FEATURES).limit(50), ["id"], specs, case_teacher)
    assert "explode(" not in found._jdf.queryExecution().executedPlan().toString()
    assert all(r["boundary_distance"] is None or 0 < r["boundary_distance"] <= 2.0 for r in found.collect())


def test_a_sweep_is_scored_without_ordering_its_grid(spark):
    """Crossings equal those of a plain loop, and no grid point is shuffled: only crossings reach the exchange."""
    x = [(1, 2.0, 5.0), (2, 9.0, 1.0), (3, 0.0, 0.0)]
    df = spark.createDataFrame(x, "id long, a double, b double")
    limits = {"a": (0.0, 10.0), "b": (-4.0, 6.0)}
    score = lambda c: (c["a"] - 4.2) * (c["a"] - 7.7) + c["b"]
    found = CF.sensitivity(df, "id", {"a": {}, "b": {}}, ["a", "b"], limits, score, points=11)
    wanted = {}
    for i, a, b in x:
        for f, (lo, hi) in limits.items():
            at = [lo + (hi - lo) * j / 10 for j in range(11)]
            s = [score({"a": a, "b": b} | {f: v}) for v in at]
            cross = [(abs(c - {"a": a, "b": b}[f]), j, c) for j in range(1, 11) if (s[j - 1] <= 0) != (s[j] <= 0) for c in [at[j - 1] - (at[j] - at[j - 1]) * s[j - 1] / (s[j] - s[j - 1])]]
            if cross:
                wanted[i, f] = min(cross)[2]
    assert {(r["id"], r["feature"]): pytest.approx(r["crossing"]) for r in found.collect()} == wanted and wanted
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_best_members_are_the_first_of_the_last_generation(spark, tables, specs):
    """``best`` ranks members where they were made, and stages too large to be compiled are split."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    pool = CF.donor_pool(judged(tables), "id", "cls", CASE_FEATURES, 3)
    run = lambda best: CF.donor_search(plan.chosen(tables, 0.02), pool, specs, case_teacher, plan.target_margin, population=12, elite=4, generations=1, best=best).toPandas()
    every, two = run(None), run(2)
    want = every.sort_values(["loss", "member"]).groupby("task").head(2)
    key = lambda df: sorted(zip(df["task"], df["member"], df["loss"], df["total"]))
    assert key(two) == key(want) and set(two["place"]) == {1, 2} and "block" not in two and "__h" not in two
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == CF.COMPILED
